"""TCP handshake fingerprints: decoding and signature texts.

A fingerprint is ``//@tcp/`` followed by version (1), IP version (1), TTL (2
hex), IP option size (1), window (4 hex), TCP options, ``+``, payload size (1)
and quirk letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.classify import lookup

FINGERPRINT_PREFIX = "//@tcp/"

# Packet size to link type; the first entry of a size wins.
MTU_TYPES = (
    ("Ethernet or modem (PPPoE)", (576, 1500)),
    ("DSL", (1452, 1454, 1492)),
    ("L2TP", (1456,)),
    ("Generic Tunnel Interface (VPN, IPSec, ...)", (1240, 1280, 1300, 1400, 1420, 1450)),
    ("IPSec or GRE", (1476,)),
    ("IPIP or SIT", (1480,)),
    ("PPTP", (1490, 1460)),
    (
        "OpenVPN",
        (1409, 1407, 1408, 1406, 1393, 1391, 1392, 1390, 1381, 1379, 1380, 1378, 1359, 1357, 1358, 1356)
        + (1343, 1341, 1342, 1340, 1331, 1329, 1330, 1328, 1309, 1308, 1307, 1306, 1293, 1291, 1292)
        + (1290, 1281, 1279, 1278, 1280),
    ),
    ("AX.25 radio modem", (256,)),
    ("SLIP", (552,)),
    ("Google", (1470,)),
    ("VLAN", (1496,)),
    ("Ericsson HIS modem", (1656,)),
    ("Jumbo Ethernet", (9000,)),
    ("Loopback interface", (3924, 16384, 16436)),
)
MTU_UNKNOWN = "Unknown"

# Initial TTLs that systems use.
TTL_CEILINGS = (32, 64, 128, 255)

# Quirk letter to short name and meaning.
QUIRKS = {
    "A": ("df", "don't fragment bit set (ipv4)"),
    "B": ("df,id+", "don't fragment bit set and id non-zero (ipv4)"),
    "C": ("id-", "don't fragment bit set and id zero (ipv4)"),
    "D": ("ecn", "ecn capable in ip header (ipv4)"),
    "E": ("flow", "flow-label non-zero (ipv6)"),
    "F": ("0+", "reserved bits non-zero (tcp)"),
    "G": ("seq-", "sequence number for syn is zero (tcp)"),
    "H": ("ack+", "ack number non-zero but ack flag not set (tcp)"),
    "I": ("ack-", "ack number zero but ack flag set (tcp) (dropped by kernel for syn)"),
    "J": ("uptr+", "urg pointer non-zero but urg flag not set (tcp)"),
    "K": ("urgf+", "urg flag set (tcp) (dropped by kernel for syn)"),
    "L": ("pushf+", "push flag set (tcp) (dropped by kernel for syn)"),
    "M": ("ts1-", "timestamp option is zero (tcp)"),
    "N": ("ts2+", "echo timestamp option is non-zero for syn (tcp)"),
    "O": ("opt+", "tcp options contain non-zero trailing bits (tcp)"),
    "P": ("exws", "tcp option window scaling factor > 14 (tcp)"),
    "Q": ("bad", "malformed tcp options (tcp)"),
}

# Option code to name; 0 (end of list) is counted, see option_names.
OPTION_NAMES = {"1": "nop", "2": "mss", "3": "ws", "4": "sok", "5": "sack", "8": "ts"}
OPTION_PATTERN = "(2.{4}|3.{2}|!.{2}|.)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _hex(c: Column) -> Column:
    return F.when(c.rlike("^[0-9A-Fa-f]+$"), F.conv(c, 16, 10).try_cast("bigint"))


def mtu_type(mtu: Column | str) -> Column:
    """Link type guessed from the packet size."""
    sizes: dict[int, str] = {}
    for name, members in MTU_TYPES:
        for size in members:
            sizes.setdefault(size, name)
    mtu = _col(mtu)
    known = lookup(sizes, mtu.cast("int"))
    return F.when(mtu.isNotNull(), F.coalesce(known, F.lit(MTU_UNKNOWN)))


def initial_ttl(ttl: Column | str) -> Column:
    """The smallest usual initial TTL that is not below the seen one."""
    ttl = _col(ttl)
    chain = F
    for ceiling in TTL_CEILINGS:
        chain = chain.when(ttl <= ceiling, F.lit(ceiling).cast("bigint"))
    return chain


def option_tokens(options: Column) -> Column:
    return F.regexp_extract_all(options, F.lit(OPTION_PATTERN), F.lit(1))


def option_names(tokens: Column) -> Column:
    """Option names in order; the end marker counts the padding that follows it.

    NULL when an option lacks (part of) its argument.
    """
    end_position = F.array_position(tokens, "0")
    padding = F.size(F.filter(tokens, lambda t: t == "0")) - 1

    def name(token: Column, index: Column) -> Column:
        return F.when((token == "0") & (index + 1 == end_position), "eol").otherwise(
            lookup(OPTION_NAMES, F.left(token, F.lit(1)))
        )

    names = F.filter(F.transform(tokens, name), lambda n: n.isNotNull())
    joined = F.array_join(names, ",")
    padded = F.when(padding > 0, F.concat(joined, F.lit("+"), padding.cast("string"))).otherwise(joined)
    return F.when(~F.exists(tokens, lambda t: t.isin("2", "3")), padded)


def _last_argument(tokens: Column, code: str) -> Column:
    """Hex argument of the last option with this code."""
    matching = F.filter(tokens, lambda t: t.startswith(code) & (F.length(t) > 1))
    return _hex(F.substring(F.try_element_at(matching, F.lit(-1)), 2, 4))


def quirk_names(letters: Column, long_form: bool = False) -> Column:
    """Array of quirk names; NULL when a letter is unknown."""
    table = {letter: names[int(long_form)] for letter, names in QUIRKS.items()}
    each = F.filter(F.split(letters, ""), lambda x: x != "")
    known = letters.rlike(f"^[{''.join(QUIRKS)}]*$")
    return F.when(known, F.transform(each, lambda x: lookup(table, x)))


def _parts(text: Column) -> Column:
    """Body, option tokens and what follows the ``+`` mark of a fingerprint."""
    body = F.substring(text, F.lit(len(FINGERPRINT_PREFIX) + 1), F.length(text))
    rest = F.substring(body, F.lit(10), F.length(body))
    has_mark = rest.contains("+")
    after = F.substring(rest, F.instr(rest, "+") + 1, F.length(rest))
    return F.struct(
        body.alias("body"),
        has_mark.alias("has_mark"),
        F.when(has_mark, after).otherwise("").alias("after"),
        option_tokens(F.substring_index(rest, "+", 1)).alias("found"),
    )


def _fields(parts: Column) -> Column:
    body, after, found = parts["body"], parts["after"], parts["found"]
    # Without a mark a last single character is not an option, and the payload
    # size falls back to the first character of the body.
    dangling = ~parts["has_mark"] & (F.length(F.try_element_at(found, F.lit(-1))) == 1)
    tokens = F.when(dangling, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)
    ttl = _hex(F.substring(body, 3, 2))
    letters = F.substring(after, F.lit(2), F.length(after))
    return F.struct(
        F.left(body, F.lit(1)).alias("format_version"),
        F.substring(body, 2, 1).alias("ip_version"),
        ttl.alias("ttl"),
        initial_ttl(ttl).alias("initial_ttl"),
        (initial_ttl(ttl) - ttl).alias("distance"),
        F.substring(body, 5, 1).alias("ip_options"),
        _hex(F.substring(body, 6, 4)).alias("window"),
        _last_argument(tokens, "2").alias("mss"),
        F.coalesce(_last_argument(tokens, "3"), F.lit(0).cast("bigint")).alias("scale"),
        option_names(tokens).alias("options"),
        F.substring(F.when(parts["has_mark"], after).otherwise(body), 1, 1).alias("payload"),
        F.array_join(quirk_names(letters), ",").alias("quirks"),
        F.array_join(quirk_names(letters, long_form=True), "; ").alias("quirk_meanings"),
    )


def decode(fingerprint: Column | str) -> Column:
    """All fields of a fingerprint as one struct; NULL for other text."""
    text = _col(fingerprint)
    # A one-item array: the text is split once and every field is read from that.
    fields = F.get(F.transform(F.array(_parts(text)), _fields), F.lit(0))
    return F.when(text.startswith(FINGERPRINT_PREFIX), fields)


def raw_signature(fields: Column) -> Column:
    """The observed signature text; NULL when there is no segment size."""
    return F.concat(
        fields["ip_version"],
        F.lit(":"),
        fields["initial_ttl"].cast("string"),
        F.lit(":"),
        fields["ip_options"],
        F.lit(":"),
        fields["mss"].cast("string"),
        F.lit(":"),
        fields["window"].cast("string"),
        F.lit(","),
        fields["scale"].cast("string"),
        F.lit(":"),
        fields["options"],
        F.lit(":"),
        fields["quirks"],
        F.lit(":"),
        fields["payload"],
    )


def general_signature(fields: Column) -> Column:
    """The signature text with the window as a whole multiple of the segment size."""
    multiple = F.floor(fields["window"] / F.nullif(fields["mss"], F.lit(0))).cast("string")
    return F.concat(
        F.lit("*:"),
        fields["initial_ttl"].cast("string"),
        F.lit(":"),
        fields["ip_options"],
        F.lit(":*:"),
        multiple,
        F.lit("*mss,"),
        fields["scale"].cast("string"),
        F.lit(":"),
        fields["options"],
        F.lit(":"),
        fields["quirks"],
        F.lit(":"),
        fields["payload"],
    )
