"""Client intelligence: attacked hosts, accounts, categories and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import bracket_list, heuristic_base_name, parse_evidences
from wardline.functions.timetokens import hour_of, in_window
from wardline.operators.search import keep_listed
from wardline.operators.skew import LIST_ITEMS, chunked_lists

DETAILS_MISSING = "(ACCOUNT DETAILS MISSING)"


def detected(
    records: DataFrame, window: tuple[int, int] | None = None, ips: list | DataFrame | None = None
) -> DataFrame:
    """Records with a detected heuristic, as they are."""
    seen = records.filter(F.col("heuristic_detected").isNotNull())
    if window:
        seen = seen.filter(in_window("ts", window))
    if ips is not None:
        seen = keep_listed(seen, "ip", ips)
    return seen.filter(F.lower("heuristic_detected") != "false").withColumn("hour", hour_of("ts"))


def detections(
    records: DataFrame,
    window: tuple[int, int] | None = None,
    ips: list | DataFrame | None = None,
    strict_names: bool = False,
) -> DataFrame:
    """Records with a detected heuristic, their packed columns opened.

    Gives ip, hour, heuristic, category, attacked_hosts, hosts and accounts; only
    the first evidence of a record counts.
    """
    flagged = detected(records, window, ips)
    first = flagged.withColumn("evidence", F.explode(F.array(F.get(parse_evidences("evidences"), F.lit(0)))))
    return first.select(
        "ip",
        "hour",
        heuristic_base_name(F.col("evidence.heuristic_name"), strict_names).alias("heuristic"),
        F.col("evidence.category").alias("category"),
        F.col("evidence.hosts").alias("attacked_hosts"),
        bracket_list("hosts").alias("hosts"),
        bracket_list("accounts").alias("accounts"),
    )


def attack_hours(found: DataFrame) -> DataFrame:
    """Distinct hours of ``detections``, or of ``detected``, which spares opening the packed columns."""
    return found.select("hour").distinct()


def rollup(found: DataFrame) -> DataFrame:
    """Distinct categories, hosts and accounts as ``(kind, value)`` rows, in one pass."""
    entries = F.concat(
        F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value"))),
        F.transform("hosts", lambda h: F.struct(F.lit("host").alias("kind"), h.alias("value"))),
        F.transform("accounts", lambda a: F.struct(F.lit("account").alias("kind"), a.alias("value"))),
    )
    opened = found.select(F.inline(entries))
    named = F.col("value").isNotNull() & ((F.col("kind") == "category") | (F.col("value") != ""))
    return opened.filter(named).distinct()


def hosts_per_heuristic(found: DataFrame, list_items: int = LIST_ITEMS) -> DataFrame:
    pairs = found.select("heuristic", F.explode("attacked_hosts").alias("host"))
    return chunked_lists(pairs, ["heuristic"], "host", "hosts", "list_part", list_items)


def heuristics_per_account(found: DataFrame, list_items: int = LIST_ITEMS) -> DataFrame:
    """Sorted heuristics per account; the empty account id is kept here."""
    pairs = found.select(F.explode("accounts").alias("account"), "heuristic")
    return chunked_lists(pairs, ["account"], "heuristic", "heuristics", "list_part", list_items)


def attacked_accounts(found: DataFrame, account_names: DataFrame, list_items: int = LIST_ITEMS) -> DataFrame:
    """Attacked accounts with their names and heuristics.

    Names are read for attacked accounts only.  Of several names the smallest is
    taken; an account without one is shown under its id.
    """
    per_account = heuristics_per_account(found, list_items).filter(F.col("account") != "")
    names = account_names.select(F.col("account").cast("string").alias("account"), "account_name")
    attacked = found.select(F.explode("accounts").alias("account")).distinct()
    known = names.join(attacked, "account", "left_semi").groupBy("account").agg(
        F.min("account_name").alias("name")
    )
    return per_account.join(known, "account", "left").select(
        "account",
        F.coalesce("name", F.lit(DETAILS_MISSING)).alias("account_name"),
        F.coalesce("name", "account").alias("sort_name"),
        "heuristics",
        "list_part",
    )


def sorted_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy("sort_name", "account", "list_part")
