"""Classification by fixed tables: rules, threat codes, shared-address size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule id to attack category.
RULE_CATEGORIES = {
    "1000": "SQLi",
    "1001": "SQLi",
    "1002": "SQLi",
    "1003": "SQLi",
    "1004": "SQLi",
    "1005": "SQLi",
    "1006": "SQLi",
    "1007": "SQLi",
    "2000": "CMDi",
    "2001": "RFI",
    "2002": "PHPi",
    "2003": "PHPi",
    "2004": "PHPi",
    "2005": "RFIi",
    "2006": "RFI",
    "2007": "PHPi",
    "2008": "PHPi",
    "2009": "Scanners",
    "3000": "Scanners",
    "4000": "XSS",
    "4001": "XSS",
    "4002": "XSS",
    "4003": "XSS",
    "4004": "XSS",
    "4005": "XSS",
    "5000": "XSS",
    "6000": "LFI",
    "6001": "LFI",
    "6002": "LFI",
    "6003": "LFI",
}

# Last octet of a block-list answer to its meaning.
THREAT_LABELS = {
    "0": "Search Engine",
    "1": "Suspicious",
    "2": "Harvester",
    "3": "Suspicious Harvester",
    "4": "Comment Spammer",
    "5": "Suspicious Comment Spammer",
    "6": "Harvester / Comment Spammer",
    "7": "Suspicious / Harvester / Comment Spammer",
}

# Report texts by number of business-related accounts.
NAT_NOT_SHARED = "IP[s] Does Not Seem To Be Shared"
NAT_SMALL = "IP[s] Seem To Be a Small Sized NAT"
NAT_MEDIUM = "IP[s] Seem To Be a Medium Sized NAT"
NAT_LARGE = "IP[s] Seem To Be a Large Sized NAT"
NAT_UNDECIDED = "Unable To Decide - Business-Related Account Count Is Too High!"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict, c: Column | str) -> Column:
    """Value of a fixed table for a key column; NULL when the key is not in it."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), _col(c))


def rule_category(c: Column | str) -> Column:
    return lookup(RULE_CATEGORIES, _col(c).cast("string"))


def threat_label(answer_ip: Column | str) -> Column:
    """Meaning of a block-list answer address, by its fourth octet."""
    return lookup(THREAT_LABELS, F.split_part(_col(answer_ip), F.lit("."), F.lit(4)))


def nat_size_guess(business_accounts: Column | str) -> Column:
    n = _col(business_accounts)
    return (
        F.when(n < 10, NAT_NOT_SHARED)
        .when(n <= 30, NAT_SMALL)
        .when(n <= 100, NAT_MEDIUM)
        .when(n <= 150, NAT_LARGE)
        .when(n > 150, NAT_UNDECIDED)
    )
