"""Records with line breaks in quoted values, and archives, against plain readings."""

import csv
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from wardline.operators.infer import accepted, parse_lines
from wardline.sources import archives
from wardline.sources.records import line_moves, read_records
from wardline.sources.writers import write_quoted_tsv


def plain_records(text):
    """Records by one pass over the characters, by the rules of common delimited files."""
    out, record, state = [], "", "start"
    for char in text:
        if char == "\n" and state != "quoted":
            out.append((record.removesuffix("\r"), None))
            record, state = "", "start"
            continue
        record += char
        if state == "quoted":
            state = "closing" if char == '"' else "quoted"
        elif state == "closing" and char == '"':
            state = "quoted"
        elif char == "\t":
            state = "start"
        elif state == "start" and char == '"':
            state = "quoted"
        else:
            state = "plain"
    # The break that ends a file is no part of its last value.
    record = record.removesuffix("\n")
    if record:
        out.append((record.removesuffix("\r"), "open quote" if state == "quoted" else None))
    return out


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    # At least so many tasks, so that the split really is that small.
    spark.conf.set("spark.sql.files.minPartitionNum", "64")


@pytest.fixture
def splits(spark):
    yield lambda size: small_splits(spark, size)
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(key)


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_records_of_random_files(spark, tmp_path, splits, size):
    rng = random.Random(4)
    texts = ["".join(rng.choices(['"', "\t", "\n", "a", "é", "\r", " "], [3, 3, 2, 8, 1, 1, 1], k=400)) for _ in range(2)]
    texts += ["", "\n", 'a\t"b\nc', '"\n' * 41, "x\ty\r\n\"1\n2\"\tz\r\n", 'p"q\tr\n5" disk\t"ok"\n', "\n\n a\n"]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k:02d}.tsv").write_bytes(text.encode())
    splits(size)
    got = read_records(spark, str(tmp_path)).collect()
    assert len({r.row_no for r in got}) == len(got) and {r.row_no for r in got} == set(range(1, len(got) + 1))
    for k, text in enumerate(texts):
        own = sorted((r.record_no, r.record, r.problem) for r in got if r.path.endswith(f"f{k:02d}.tsv"))
        assert own == [(n, *r) for n, r in enumerate(plain_records(text), 1)], k
    ordered = sorted(got, key=lambda r: (r.path, r.record_no))
    assert [r.row_no for r in ordered] == list(range(1, len(got) + 1))


def test_long_records_are_told(spark, tmp_path, splits):
    (tmp_path / "a.tsv").write_text('h\tk\n1\t"' + "line\n" * 150 + '"\n2\tx\n3\t"never closed\n' + "y\n" * 300)
    splits(64)
    got = {r.record_no: (r.problem, r.record) for r in read_records(spark, str(tmp_path), most=500).collect()}
    assert got[1] == (None, "h\tk") and got[2] == ("too long", None) and got[3] == (None, "2\tx") and got[4] == ("too long", None)
    assert len(got) == 4


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_values_come_back(spark, tmp_path, splits, escape):
    values = [(k, f'say "hi"\n\tline {k}\r\nback\\slash', "" if k % 3 else None) for k in range(40)] + [(200, '"', "\n"), (201, '\\"', "\\")]
    frame = spark.createDataFrame(values, "id long, text string, more string")
    path = str(tmp_path / "out")
    if escape == "\\":
        write_quoted_tsv(frame, path)
    else:
        (tmp_path / "out").mkdir()
        with open(f"{path}/part.tsv", "w", newline="") as out:
            writer = csv.writer(out, delimiter="\t", lineterminator="\n")
            writer.writerow(frame.columns)
            writer.writerows(["" if v is None else v for v in row] for row in values)
    splits(200)
    records = read_records(spark, path, escape=escape).where("record_no > 1 and problem is null")
    parsed = accepted(parse_lines(records, ["id", "text", "more"], "record", escape=escape))
    got = sorted((int(r._f0), r._f1, r._f2) for r in parsed.collect())
    assert got == [(i, t, m or "") for i, t, m in values]


def test_moves_do_not_recurse(spark):
    """Long fields and many quotes neither overflow the stack nor run for long."""
    long = ['"' + '""' * 200_000, '"a"\t' * 100_000, "x" * 1_000_000 + '"', '"' + "y\t" * 200_000]
    frame = spark.createDataFrame([(t,) for t in long], "line string")
    out, inside = line_moves(F.col("line"))
    assert [tuple(r) for r in frame.select(out, inside).collect()] == [(True, False), (False, False), (False, False), (True, False)]


# ---------------------------------------------------------------- archives


def member(archive, name, text):
    info = tarfile.TarInfo(name)
    info.size = len(text)
    archive.addfile(info, io.BytesIO(text))


def test_archives_and_plain_files(spark, tmp_path):
    import gzip

    with tarfile.open(tmp_path / "a.tgz", "w:gz") as archive:
        member(archive, "readme", b"no\n")
        member(archive, "x.db.1", "one\r\n\ntwo é\xff".encode("latin-1"))
        member(archive, "y.db", b"later\n")
    with tarfile.open(tmp_path / "b.tar", "w") as archive:
        member(archive, "readme", b"no\n")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"p\nq\n"))
    (tmp_path / "d.txt").write_bytes(b"r")
    (tmp_path / "e.tgz").write_bytes(gzip.compress(b""))
    (tmp_path / "_hidden").write_bytes(b"no\n")
    got = sorted((r.path.rsplit("/")[-1], r.member, r.line_no, r.line) for r in archives.read_archives(spark, str(tmp_path)).collect())
    assert got == [
        ("a.tgz", "x.db.1", 1, "one\r"), ("a.tgz", "x.db.1", 2, ""), ("a.tgz", "x.db.1", 3, "two ��"),
        ("c.gz", "", 1, "p"), ("c.gz", "", 2, "q"), ("d.txt", "", 1, "r"),
    ]
    assert archives.read_archives(spark, f"file:{tmp_path}/c*").count() == 2
    with pytest.raises(Exception, match="none"):
        archives.read_archives(spark, f"{tmp_path}/none").count()


def test_damaged_archive_is_an_error(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as archive:
        member(archive, "x.db", bytes(random.Random(1).randbytes(100_000)))
    whole = (tmp_path / "a.tgz").read_bytes()
    (tmp_path / "a.tgz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="EOF|[Uu]nexpected|end of"):
        archives.read_archives(spark, str(tmp_path)).count()


def test_written_archives(spark, tmp_path):
    lines = spark.range(0, 5000, 1, 3).selectExpr("concat('line ', id) AS line")
    path = str(tmp_path / "out")
    archives.write_archives(lines, path, archive_bytes=10_000)
    files = [f.name for f in (tmp_path / "out").iterdir()]
    assert len(files) > 3 and not any(f.startswith("_") for f in files)
    got = archives.read_archives(spark, path)
    assert sorted(r.line for r in got.collect()) == sorted(r.line for r in lines.collect())
    with pytest.raises(Exception):
        archives.write_archives(lines, path)
    archives.write_archives(lines.limit(3), path, mode="overwrite")
    assert archives.read_archives(spark, path).count() == 3


def test_reading_holds_a_batch_only(tmp_path):
    """Memory stays flat when a member grows tenfold."""
    import tracemalloc

    peaks = []
    for k in (1, 10):
        path = tmp_path / f"m{k}.tgz"
        with tarfile.open(path, "w:gz") as archive:
            member(archive, "x.db", b"".join(b"%x\n" % random.getrandbits(120) for _ in range(40_000 * k)))
        reader = archives.ArchiveReader({"path": str(path)})
        tracemalloc.start()
        assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 40_000 * k
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 64 << 20
