"""User-agent text to operating system, device, browser and browser version.

A modest ordered rule table; the first matching rule wins and anything else is
``Other``.  Known systems: Windows, iOS, Mac OS X, Android, Chrome OS, Linux.
Known browsers: Edge, Opera, IE, Firefox, Chrome, Safari (with their mobile
forms), the old Android one and the command-line clients curl, Wget and Python Requests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Other"

OS_RULES = (
    ("Windows Phone", "Windows Phone"),
    ("Windows", "Windows"),
    ("iPhone|iPad|iPod", "iOS"),
    ("Mac OS X|Macintosh", "Mac OS X"),
    ("Android", "Android"),
    ("CrOS", "Chrome OS"),
    ("Linux|X11", "Linux"),
)

DEVICE_RULES = (
    ("iPhone", "iPhone"),
    ("iPad", "iPad"),
    ("iPod", "iPod"),
    ("Macintosh", "Mac"),
    (r"(?i)bot\b|crawler|spider", "Spider"),
)
ANDROID_MODEL = r"Android[^;)]*;\s*(?:[a-z]{2}[-_][a-zA-Z]{2};\s*)?([^;)]+?)(?:\s+Build/[^;)]*)?[;)]"

BROWSER_RULES = (
    (r"Edg(?:e|A|iOS)?/([0-9.]+)", "Edge"),
    (r"(?:OPR|Opera)/([0-9.]+)", "Opera"),
    (r"(?:MSIE |Trident/.*rv:)([0-9.]+)", "IE"),
    (r"FxiOS/([0-9.]+)", "Firefox iOS"),
    (r"Android.*Firefox/([0-9.]+)", "Firefox Mobile"),
    (r"Firefox/([0-9.]+)", "Firefox"),
    (r"CriOS/([0-9.]+)", "Chrome Mobile iOS"),
    (r"Chrome/([0-9.]+) Mobile", "Chrome Mobile"),
    (r"Chrome/([0-9.]+)", "Chrome"),
    (r"Android.*Version/([0-9.]+).* Safari/", "Android"),
    (r"Version/([0-9.]+).* Mobile/.*Safari/", "Mobile Safari"),
    (r"Version/([0-9.]+).* Safari/", "Safari"),
    (r"curl/([0-9.]+)", "curl"),
    (r"Wget/([0-9.]+)", "Wget"),
    (r"python-requests/([0-9.]+)", "Python Requests"),
)


def _first_match(ua: Column, rules: tuple) -> Column:
    chain = F
    for pattern, name in rules:
        chain = chain.when(ua.rlike(pattern), name)
    return chain


def os_family(ua: Column) -> Column:
    return _first_match(ua, OS_RULES).otherwise(UNKNOWN)


def device_family(ua: Column) -> Column:
    model = F.nullif(F.regexp_extract(ua, ANDROID_MODEL, 1), F.lit(""))
    return F.coalesce(_first_match(ua, DEVICE_RULES), model, F.lit(UNKNOWN))


def browser_family(ua: Column) -> Column:
    return _first_match(ua, BROWSER_RULES).otherwise(UNKNOWN)


def browser_version(ua: Column) -> Column:
    """Up to three version parts, ``''`` when the browser is unknown."""
    chain = F
    for pattern, _ in BROWSER_RULES:
        chain = chain.when(ua.rlike(pattern), F.regexp_extract(ua, pattern, 1))
    return F.substring_index(chain.otherwise(""), ".", 3)


def parsed_columns(ua: Column | str) -> list[Column]:
    """The four parsed columns, named os, device, browser and browser_version."""
    c = F.coalesce(F.col(ua) if isinstance(ua, str) else ua, F.lit(""))
    return [
        os_family(c).alias("os"),
        device_family(c).alias("device"),
        browser_family(c).alias("browser"),
        browser_version(c).alias("browser_version"),
    ]
