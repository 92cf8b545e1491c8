"""Matching decoded handshakes against operating-system signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signature texts per system label.
SIGNATURES = {
    "s:unix:Linux:3.11 and newer": [
        "*:64:0:*:mss*20,10:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*20,7:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:3.1-3.10": [
        "*:64:0:*:mss*10,4:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*10,5:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*10,6:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*10,7:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:2.6.x": [
        "*:64:0:*:mss*4,6:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*4,7:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*4,8:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:2.4.x": [
        "*:64:0:*:mss*4,0:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*4,1:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*4,2:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:2.2.x": [
        "*:64:0:*:mss*11,0:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*20,0:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*22,0:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:2.0": ["*:64:0:*:mss*12,0:mss::0", "*:64:0:*:16384,0:mss::0"],
    "s:unix:Linux:3.x (loopback)": [
        "*:64:0:16396:mss*2,4:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:16376:mss*2,4:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:2.6.x (loopback)": [
        "*:64:0:16396:mss*2,2:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:16376:mss*2,2:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "s:unix:Linux:2.4.x (loopback)": ["*:64:0:16396:mss*2,0:mss,sok,ts,nop,ws:df,id+:0"],
    "s:unix:Linux:2.2.x (loopback)": ["*:64:0:3884:mss*8,0:mss,sok,ts,nop,ws:df,id+:0"],
    "s:unix:Linux:2.6.x (Google crawler)": ["4:64:0:1430:mss*4,6:mss,sok,ts,nop,ws::0"],
    "s:unix:Linux:(Android)": [
        "*:64:0:*:mss*44,1:mss,sok,ts,nop,ws:df,id+:0",
        "*:64:0:*:mss*44,3:mss,sok,ts,nop,ws:df,id+:0",
    ],
    "g:unix:Linux:3.x": ["*:64:0:*:mss*10,*:mss,sok,ts,nop,ws:df,id+:0"],
    "g:unix:Linux:2.4.x-2.6.x": ["*:64:0:*:mss*4,*:mss,sok,ts,nop,ws:df,id+:0"],
    "g:unix:Linux:2.2.x-3.x": ["*:64:0:*:*,*:mss,sok,ts,nop,ws:df,id+:0"],
    "g:unix:Linux:2.2.x-3.x (no timestamps)": ["*:64:0:*:*,*:mss,nop,nop,sok,nop,ws:df,id+:0"],
    "g:unix:Linux:2.2.x-3.x (barebone)": ["*:64:0:*:*,0:mss:df,id+:0"],
    "s:win:Windows:XP": [
        "*:128:0:*:16384,0:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:65535,0:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:65535,0:mss,nop,ws,nop,nop,sok:df,id+:0",
        "*:128:0:*:65535,1:mss,nop,ws,nop,nop,sok:df,id+:0",
        "*:128:0:*:65535,2:mss,nop,ws,nop,nop,sok:df,id+:0",
    ],
    "s:win:Windows:7 or 8": [
        "*:128:0:*:8192,0:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:8192,2:mss,nop,ws,nop,nop,sok:df,id+:0",
        "*:128:0:*:8192,8:mss,nop,ws,nop,nop,sok:df,id+:0",
        "*:128:0:*:8192,2:mss,nop,ws,sok,ts:df,id+:0",
    ],
    "s:win:Windows:7 (Websense crawler)": [
        "*:64:0:1380:mss*4,6:mss,nop,nop,ts,nop,ws:df,id+:0",
        "*:64:0:1380:mss*4,7:mss,nop,nop,ts,nop,ws:df,id+:0",
    ],
    "g:win:Windows:NT kernel 5.x": [
        "*:128:0:*:16384,*:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:65535,*:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:16384,*:mss,nop,ws,nop,nop,sok:df,id+:0",
        "*:128:0:*:65535,*:mss,nop,ws,nop,nop,sok:df,id+:0",
    ],
    "g:win:Windows:NT kernel 6.x": [
        "*:128:0:*:8192,*:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:8192,*:mss,nop,ws,nop,nop,sok:df,id+:0",
    ],
    "g:win:Windows:NT kernel": [
        "*:128:0:*:*,*:mss,nop,nop,sok:df,id+:0",
        "*:128:0:*:*,*:mss,nop,ws,nop,nop,sok:df,id+:0",
    ],
    "s:unix:Mac OS X:10.x": [
        "*:64:0:*:65535,1:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0",
        "*:64:0:*:65535,3:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0",
    ],
    "s:unix:MacOS X:10.9 or newer (sometimes iPhone or iPad)": [
        "*:64:0:*:65535,4:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0",
    ],
    "s:unix:iOS:iPhone or iPad": ["*:64:0:*:65535,2:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0"],
    "g:unix:Mac OS X:": ["*:64:0:*:65535,*:mss,nop,ws,nop,nop,ts,sok,eol+1:df,id+:0"],
    "s:unix:FreeBSD:9.x or newer": ["*:64:0:*:65535,6:mss,nop,ws,sok,ts:df,id+:0"],
    "s:unix:FreeBSD:8.x": ["*:64:0:*:65535,3:mss,nop,ws,sok,ts:df,id+:0"],
    "g:unix:FreeBSD:": ["*:64:0:*:65535,*:mss,nop,ws,sok,ts:df,id+:0"],
    "s:unix:OpenBSD:3.x": ["*:64:0:*:16384,0:mss,nop,nop,sok,nop,ws,nop,nop,ts:df,id+:0"],
    "s:unix:OpenBSD:4.x-5.x": ["*:64:0:*:16384,3:mss,nop,nop,sok,nop,ws,nop,nop,ts:df,id+:0"],
    "s:unix:Solaris:8": ["*:64:0:*:32850,1:nop,ws,nop,nop,ts,nop,nop,sok,mss:df,id+:0"],
    "s:unix:Solaris:10": ["*:64:0:*:mss*34,0:mss,nop,ws,nop,nop,sok:df,id+:0"],
    "s:unix:OpenVMS:8.x": ["4:128:0:1460:mtu*2,0:mss,nop,ws::0"],
    "s:unix:OpenVMS:7.x": ["4:64:0:1460:61440,0:mss,nop,ws::0"],
    "s:other:NeXTSTEP:": ["4:64:0:1024:mss*4,0:mss::0"],
    "s:unix:Tru64:4.x": ["4:64:0:1460:32768,0:mss,nop,ws:df,id+:0"],
    "s:!:NMap:SYN scan": [
        "*:64-:0:1460:1024,0:mss::0",
        "*:64-:0:1460:2048,0:mss::0",
        "*:64-:0:1460:3072,0:mss::0",
        "*:64-:0:1460:4096,0:mss::0",
    ],
    "s:!:NMap:OS detection": [
        "*:64-:0:265:512,0:mss,sok,ts:ack+:0",
        "*:64-:0:0:4,10:sok,ts,ws,eol+0:ack+:0",
        "*:64-:0:1460:1,10:ws,nop,mss,ts,sok:ack+:0",
        "*:64-:0:536:16,10:mss,sok,ts,ws,eol+0:ack+:0",
        "*:64-:0:640:4,5:ts,nop,nop,ws,nop,mss:ack+:0",
        "*:64-:0:1400:63,0:mss,ws,sok,ts,eol+0:ack+:0",
        "*:64-:0:265:31337,10:ws,nop,mss,ts,sok:ack+:0",
        "*:64-:0:1460:3,10:ws,nop,mss,sok,nop,nop:ecn,uptr+:0",
    ],
    "s:unix:p0f:sendsyn utility": [
        "*:192:0:1331:1337,0:mss,nop,eol+18::0",
        "*:192:0:1331:1337,0:mss,ts,nop,eol+8::0",
        "*:192:0:1331:1337,5:mss,ws,nop,eol+15::0",
        "*:192:0:1331:1337,0:mss,sok,nop,eol+16::0",
        "*:192:0:1331:1337,5:mss,ws,ts,nop,eol+5::0",
        "*:192:0:1331:1337,0:mss,sok,ts,nop,eol+6::0",
        "*:192:0:1331:1337,5:mss,ws,sok,nop,eol+13::0",
        "*:192:0:1331:1337,5:mss,ws,sok,ts,nop,eol+3::0",
    ],
    "s:other:Blackberry:": ["*:128:0:1452:65535,0:mss,nop,nop,sok,nop,nop,ts::0"],
    "s:other:Nintendo:3DS": ["*:64:0:1360:32768,0:mss,nop,nop,sok:df,id+:0"],
    "s:other:Nintendo:Wii": ["4:64:0:1460:32768,0:mss,nop,nop,sok:df,id+:0"],
    "s:unix:BaiduSpider:": [
        "*:64:0:1460:mss*4,7:mss,sok,nop,nop,nop,nop,nop,nop,nop,nop,nop,nop,nop,ws:df,id+:0",
        "*:64:0:1460:mss*4,2:mss,sok,nop,nop,nop,nop,nop,nop,nop,nop,nop,nop,nop,ws:df,id+:0",
    ],
}

_FIELDS = "version ttl ip_options mss window_scale options quirks payload".split()


def signature_table(spark: SparkSession, strict: bool = False) -> DataFrame:
    """Signatures with their fields split; 91 rows, fixed.

    ``strict`` leaves multiples of the segment size and open TTLs unmatched.
    """
    texts = [(label, text) for label, group in SIGNATURES.items() for text in group]
    part = F.split("signature", ":")
    named = [part[i].alias(f"s_{name}") for i, name in enumerate(_FIELDS)]
    table = spark.createDataFrame(texts, "os string, signature string").select("os", "signature", *named)
    window = F.substring_index("s_window_scale", ",", 1)
    ready = table.select(
        "*",
        window.alias("s_window"),
        F.substring_index("s_window_scale", ",", -1).alias("s_scale"),
        F.when(window.contains("*"), F.substring_index(window, "*", -1).try_cast("bigint")).alias("s_multiple"),
        F.when(window.startswith("mtu"), F.lit(40)).otherwise(0).alias("s_header"),
    )
    if strict:
        return ready.withColumn("s_multiple", F.lit(None).cast("bigint"))
    return ready.withColumn("s_ttl", F.rtrim("s_ttl", F.lit("-")))


def match_signatures(decoded: DataFrame, fields: str = "decoded", strict: bool = False) -> DataFrame:
    """Every signature that fits each row's decoded struct.

    Equality on options, quirks, payload and IP options is the join key; the
    fields with wildcards are checked on the few candidates left.  The signature
    table has a fixed size, so sending it to every task is safe.
    """
    d = F.col(fields)
    s = F.broadcast(signature_table(decoded.sparkSession, strict))
    same_key = (
        (d["options"] == F.col("s_options"))
        & (d["quirks"] == F.col("s_quirks"))
        & (d["payload"] == F.col("s_payload"))
        & (d["ip_options"] == F.col("s_ip_options"))
    )

    def fits(pattern: str, value: Column) -> Column:
        return (F.col(pattern) == "*") | (F.col(pattern) == value.cast("string"))

    multiple = (d["mss"] + F.col("s_header")) * F.col("s_multiple") == d["window"]
    others = (
        fits("s_version", d["ip_version"])
        & fits("s_ttl", d["initial_ttl"])
        & fits("s_mss", d["mss"])
        & (fits("s_window", d["window"]) | F.coalesce(multiple, F.lit(False)))
        & fits("s_scale", d["scale"])
    )
    kept = [*decoded.columns, "os", "signature"]
    return decoded.join(s, same_key & others).select(*kept)
