"""One investigation of a set of addresses over all log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.plans import evidence, intel, login, nat

TABLES = "requests accounts industries networks logins intel scores properties host_stats".split()


def investigate(
    tables: dict[str, DataFrame],
    addresses: DataFrame,
    window: tuple[int, int],
    intel_window: tuple[int, int] | None = None,
    excluded_names: str | None = None,
) -> dict[str, DataFrame]:
    """All parts of the report as lazy DataFrames.

    ``tables`` holds the inputs named in ``TABLES``; ``addresses`` is one column of
    addresses, e.g. from ``list_addresses``.  Client intelligence, and what depends
    on it (attacked accounts, evidence of the attack hours), is included when
    ``intel_window`` is given.  Nothing runs until a part is used.
    """
    missing = [name for name in TABLES if name not in tables]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")
    t = tables
    result = nat.nat_detection(
        t["requests"], t["accounts"], t["industries"], t["networks"], window, addresses, excluded_names
    )
    parts = {
        "nat": nat.sorted_result(nat.with_agents(result)),
        "agent_kinds": nat.agent_kinds(result),
        "agent_distribution": nat.agent_distribution(result),
        "account_labels": nat.account_labels(result),
        "account_split": nat.account_split(result),
        "size_guess": nat.size_guess(result),
        "address_details": nat.first_attributes(result),
        "logins": login.login_profile(t["logins"], window, addresses),
        "login_totals": login.login_totals(login.login_counts(t["logins"], window, addresses)),
    }
    if intel_window is not None:
        found = intel.detections(t["intel"], intel_window, addresses)
        parts |= {
            "attack_summary": intel.rollup(found),
            "hosts_per_heuristic": intel.hosts_per_heuristic(found),
            "attacked_accounts": intel.sorted_accounts(intel.attacked_accounts(found, t["accounts"])),
            "evidence": evidence.gather_evidence(
                t["scores"], t["properties"], t["host_stats"], t["networks"], intel.attack_hours(intel.detected(t["intel"], intel_window, addresses)), addresses
            ),
        }
    return parts
