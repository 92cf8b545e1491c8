import io
import tarfile

import pytest

from wardline.driver.queries import MONTH
from wardline.driver.views import view
from wardline.plans import addresses
from wardline.plans.investigate import TABLES, investigate
from wardline.sources.readers import read_space_log


def test_listing(spark):
    tokens = addresses.tokens_frame(spark, ["(10.0.0.1),", "10.0.0.0/30", "10.0.0.9-11", "10.0.0.9", "nonsense"])
    got = sorted(r.ip for r in addresses.list_addresses(tokens).collect())
    assert got == sorted([f"10.0.0.{i}" for i in (0, 1, 2, 3, 9, 10, 11)])
    assert [r.value for r in addresses.unusable_tokens(tokens).collect()] == ["nonsense"]


def test_search_files(spark, tmp_path):
    body = "first 10.0.0.2\nnothing\nlast x10.0.0.10y 9.9.9.9\n"
    (tmp_path / "plain.txt").write_text(body)
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        info = tarfile.TarInfo("ips.db")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body.encode()))
    tokens = addresses.tokens_frame(spark, ["10.0.0.0/30"])
    for name in ("plain.txt", "a.tgz"):
        rows = addresses.search_files(spark, str(tmp_path / name), tokens).collect()
        assert sorted((r.line_no, r.ip) for r in rows) == [(1, "10.0.0.2"), (3, "10.0.0.1")]
        assert {r.line for r in rows} == {"first 10.0.0.2", "last x10.0.0.10y 9.9.9.9"}


def test_short_first_log_line(spark, tmp_path):
    (tmp_path / "x.log").write_text("a b\n" + " ".join(str(i) for i in range(80)) + "\n")
    rows = read_space_log(spark, str(tmp_path / "x.log")).collect()
    assert len(rows[0]) == 73 and rows[0]["_c72"] is None and rows[1]["_c72"] == "72"


def test_investigation(spark, sf_dir):
    tables = {name: view(spark, sf_dir, name) for name in TABLES}
    chosen = addresses.list_addresses(addresses.tokens_frame(spark, ["10.0.0.0/16"]))
    parts = investigate(tables, chosen, MONTH, intel_window=MONTH, excluded_names="iran")
    counts = {name: len(frame.collect()) for name, frame in parts.items()}
    assert all(counts.values()), counts
    assert {r.ip.split(".")[1] for r in parts["nat"].collect()} == {"0"}
    assert counts["size_guess"] == 1 and counts["address_details"] == len({r.ip for r in parts["nat"].collect()})
    assert "evidence" not in investigate(tables, chosen, MONTH)
    with pytest.raises(ValueError):
        investigate({}, chosen, MONTH)
