"""Shared-address (NAT) detection and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.classify import nat_size_guess
from wardline.functions.timetokens import in_window
from wardline.functions.useragent import parsed_columns
from wardline.operators.activity import distinct_share, first_row_per
from wardline.operators.ranges import enrich
from wardline.operators.search import fits_in_tasks, keep_listed

# The industries that mark an account as business-related, and
# the one that is reported on its own.
BUSINESS_SUBVERTICALS = (
    "Logistics",
    "Advertising Technology",
    "Enterprise Software (B2B)",
    "Enterprise Hardware",
    "Asset Management",
    "Business Services",
    "BPO",
    "Information Services",
    "Security Software",
)
BUSINESS_VERTICALS = ("Software as a Service", "Business Services")
AD_SUBVERTICAL = "Advertising Technology"
NO_SUBVERTICAL = "Sub-Vertical Not Found"

RESULT_COLUMNS = (
    "ip account_name subvertical ua total company country domain network_type asnum".split()
)


def _windowed(df: DataFrame, window: tuple[int, int] | None) -> DataFrame:
    return df.filter(in_window("ts", window)) if window and "ts" in df.columns else df


def business_accounts(
    accounts: DataFrame, industries: DataFrame, window: tuple[int, int] | None = None, excluded_names: str | None = None
) -> DataFrame:
    """``(cpcode, account_name, subvertical)`` of business-related accounts."""
    named = _windowed(accounts, window)
    if excluded_names is not None:
        named = named.filter(~F.lower("account_name").rlike(excluded_names))
    named = named.select("cpcode", "account_name", F.col("account").alias("account_id")).distinct()
    business = F.col("subvertical").isin(*BUSINESS_SUBVERTICALS) | F.col("vertical").isin(*BUSINESS_VERTICALS)
    fields = _windowed(industries, window).filter(business).select("account_id", "vertical", "subvertical").distinct()
    return named.join(fields, "account_id").select("cpcode", "account_name", "subvertical")


def nat_detection(
    requests: DataFrame,
    accounts: DataFrame,
    industries: DataFrame,
    networks: DataFrame | None,
    window: tuple[int, int] | None = None,
    ips: list | DataFrame | None = None,
    excluded_names: str | None = None,
) -> DataFrame:
    """Requests per address, business-related account and user agent.

    The industry filter makes both account joins inner ones, so the two account
    tables are joined first.  If they leave few codes, requests of other codes
    are dropped before anything is exchanged; if not, requests are summed first
    and joined then.  Network attributes are looked up last, for the rows that are
    left; reports that need none of them pass ``networks=None``.
    ``excluded_names`` is a pattern on lower-case account names.
    """
    wanted = business_accounts(accounts, industries, window, excluded_names)
    seen = _windowed(requests, window).filter(F.col("ip").isNotNull())
    if ips is not None:
        seen = keep_listed(seen, "ip", ips)
    codes = wanted.select("cpcode").distinct()
    if fits_in_tasks(accounts) or fits_in_tasks(codes):
        seen = keep_listed(seen, "cpcode", codes, small=True)
    totals = seen.groupBy("ip", "cpcode", F.col("user_agent").alias("ua")).agg(
        F.sum("total_counter").alias("total")
    )
    matched = totals.join(wanted, "cpcode").select("ip", "account_name", "subvertical", "ua", "total")
    if networks is None:
        return matched
    # Every row passes this filter.  As it names the total, the addresses come out
    # of the same summed exchange as the rows, and requests are read only once.
    addresses = matched.filter(F.col("ip").isNotNull() | F.col("total").isNotNull()).select("ip").distinct()
    return enrich(matched, networks, addresses=addresses).select(*RESULT_COLUMNS)


def sorted_result(result: DataFrame) -> DataFrame:
    """Result in address order (text order), for a listing."""
    return result.orderBy("ip")


def parse_agents(result: DataFrame, ua: str = "ua") -> DataFrame:
    """Distinct user agents with system, device, browser and version.

    Parsing distinct texts only keeps the pattern work off the row count.
    """
    return result.select(ua).distinct().select(ua, *parsed_columns(ua))


def with_agents(result: DataFrame, ua: str = "ua") -> DataFrame:
    """Every row with its parsed user agent, as written to the result file."""
    return result.select("*", *parsed_columns(ua))


def agent_distribution(result: DataFrame) -> DataFrame:
    """Distinct user agents per system, device and browser."""
    return distinct_share(parse_agents(result), "ua", ["os", "device", "browser"])


def agent_kinds(result: DataFrame) -> DataFrame:
    """How many different systems, devices, browsers and user agents occur."""
    agents = parse_agents(result)
    counts = [F.count_distinct(c).alias(f"{c}_count") for c in ("os", "device", "browser")]
    return agents.agg(*counts, F.count("ua").alias("ua_count"))


def account_label(subvertical: Column | str = "subvertical", name: Column | str = "account_name") -> Column:
    """``<sub-vertical> --> <account>``; an empty or missing sub-vertical is named."""
    sub = F.col(subvertical) if isinstance(subvertical, str) else subvertical
    acc = F.col(name) if isinstance(name, str) else name
    shown = F.when(F.coalesce(sub, F.lit("")) == "", NO_SUBVERTICAL).otherwise(sub)
    return F.concat(shown, F.lit(" --> "), F.coalesce(acc, F.lit("")))


def account_labels(result: DataFrame) -> DataFrame:
    return result.select(account_label().alias("label")).distinct().orderBy("label")


def account_split(result: DataFrame, by: list[str] | None = None, first_row: bool = False) -> DataFrame:
    """Accounts, distinct user agents and requests, advertising against the rest.

    By default all rows count.  ``first_row`` takes user agents and totals of
    advertising accounts, and totals of the others, from the first row per label
    only (in order of address, user agent and total).  Business user agents are
    all distinct ones less those of advertising accounts.  ``by`` gives the split
    per key, e.g. per address.
    """
    keys = by or []
    rows = result.select(
        "ip", "ua", "total", account_label().alias("label"), (F.coalesce("subvertical", F.lit("")) == AD_SUBVERTICAL).alias("ad")
    )
    ad = F.col("ad")
    agents = [F.count_distinct("ua").alias("all_uas"), F.count_distinct("label").alias("accounts")]
    ad_parts = [
        F.count_distinct(F.when(ad, F.col("label"))).alias("ad_accounts"),
        F.count_distinct(F.when(ad, F.col("ua"))).alias("ad_uas"),
        F.coalesce(F.sum(F.when(ad, F.col("total"))), F.lit(0)).alias("ad_requests"),
        F.coalesce(F.sum(F.when(~ad, F.col("total"))), F.lit(0)).alias("business_requests"),
    ]
    if not first_row:
        split = rows.groupBy(*keys).agg(*agents, *ad_parts)
    else:
        order = [c for c in ("ip", "ua", "total") if c not in keys]
        firsts = first_row_per(rows, [*keys, "label"], order, [*order, "ad"])
        head, tail = rows.groupBy(*keys).agg(*agents), firsts.groupBy(*keys).agg(*ad_parts)
        if keys:
            split = head.join(tail, keys)
        else:
            one_row = head.select(F.struct("all_uas", "accounts")).scalar()
            split = tail.select("*", one_row.alias("head")).select("*", "head.all_uas", "head.accounts")
    return split.select(
        *keys,
        "ad_accounts",
        "ad_uas",
        "ad_requests",
        (F.col("accounts") - F.col("ad_accounts")).alias("business_accounts"),
        (F.col("all_uas") - F.col("ad_uas")).alias("business_uas"),
        "business_requests",
    )


def size_guess(result: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Likely size of the network behind the addresses, from business accounts."""
    counts = account_split(result, by).select(*(by or []), "business_accounts")
    return counts.withColumn("guess", nat_size_guess("business_accounts"))


def first_attributes(result: DataFrame) -> DataFrame:
    """Network attributes per address, from its first row in a fixed order."""
    order = ["account_name", "subvertical", "ua", "total"]
    columns = ["company", "country", "domain", "network_type", "asnum"]
    return first_row_per(result, ["ip"], order, columns)
