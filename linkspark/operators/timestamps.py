"""Normalise free-text timestamps to UTC instants.

All formats are compiled into one alternation with named groups.  A single
``regexp_replace`` pass rewrites a value into its components (the groups of the
alternatives that did not match contribute nothing), the components are range
checked, and the instant is put together with integer day arithmetic.  Zone
rules come from the JVM's tz database through ``to_utc_timestamp``, so the whole
operator is one projection of built-in expressions: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\u0001"
#: Month names of the languages in use, in calendar order.
MONTHS = [
    "january jan janvier janv enero ene januar jän gennaio gen januari janeiro января январь янв",
    "february feb février févr febrero februar febbraio februari fevereiro fev февраля февраль фев",
    "march mar mars marzo märz maart mrt março марта март мар",
    "april apr avril avr abril abr aprile апреля апрель апр",
    "may mai mayo maggio mag mei maio мая май",
    "june jun juin junio juni giugno giu junho июня июнь июн",
    "july jul juillet juil julio juli luglio lug julho июля июль июл",
    "august aug août agosto ago augustus августа август авг",
    "september sep sept septembre septiembre settembre set setembro сентября сентябрь сен",
    "october oct octobre octubre oktober okt ottobre ott outubro out октября октябрь окт",
    "november nov novembre noviembre novembro ноября ноябрь ноя",
    "december dec décembre déc diciembre dic dezember dez dicembre dezembro декабря декабрь дек",
]
#: Zone abbreviations that mean daylight-saving time; any other one means standard time.
SUMMER = r"^(?:[A-Z]+DT|BST|WEST|CEST|EEST|MSD)$"
FIELDS = "y mo d mon doy wk wd h mi s f ap off utc abbr tz ep".split()

_DATE_SEP = r"(?:[Tt]|\s*,\s*|\s+(?:(?:at|à|um|alle|às|a\s+las|om|в)\s+)?)"


def _time(n: str, upto: str = r"\s*") -> str:
    return (
        rf"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d\d)(?::(?<s{n}>\d\d)(?:[.,](?<f{n}>\d+))?)?"
        rf"(?:{upto}(?<ap{n}>[AaPp])\.?[Mm]\.?)?(?:\s+Uhr|\s*h)?"
    )


def _zone(n: str) -> str:
    return (
        rf"(?:\s*(?:(?<utc{n}>[Zz]|(?:UTC|GMT|utc|gmt)(?![+\-\d]))|(?:UTC|GMT)?(?<off{n}>[+\-]\d\d?(?::?\d\d(?::?\d\d)?)?)"
        rf"|(?<abbr{n}>[A-Z]{{2,5}})))?(?:\s*\[(?<tz{n}>[A-Za-z_+\-0-9/]+)\])?"
    )


def _formats() -> list[str]:
    names = "|".join(sorted({w for row in MONTHS for w in row.split()}, key=lambda w: (-len(w), w)))
    weekday = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"

    def month(n: str) -> str:
        return rf"(?<mon{n}>(?iu:{names}))\.?(?!\p{{L}})"

    return [
        r"(?<ep1>\d{1,7}|\d{9,13}|\d{15,19})",
        r"(?<y2>\d{4})(?<mo2>\d\d)(?<d2>\d\d)(?:[Tt\s]?(?<h2>\d\d)(?<mi2>\d\d)(?<s2>\d\d)(?:[.,](?<f2>\d+))?" + _zone("2") + ")?",
        rf"(?<y3>\d{{4}})[-/.](?<mo3>\d\d?)[-/.](?<d3>\d\d?)(?:{_DATE_SEP}{_time('3')}{_zone('3')})?",
        rf"(?<y4>\d{{4}})-(?<doy4>\d{{3}})(?:{_DATE_SEP}{_time('4')}{_zone('4')})?",
        rf"(?<y5>\d{{4}})-?[Ww](?<wk5>\d\d)-?(?<wd5>\d)(?:{_DATE_SEP}{_time('5')}{_zone('5')})?",
        # day and month in figures: for these `d` holds the first number and `mo` the second
        rf"(?<d6>\d\d?)(?<slash6>[/\-])(?<mo6>\d\d?)[/\-](?<y6>\d{{4}})(?:{_DATE_SEP}{_time('6')}{_zone('6')})?",
        rf"(?<d7>\d\d?)\.\s?(?<mo7>\d\d?)\.\s?(?<y7>\d{{4}})(?:{_DATE_SEP}{_time('7')}{_zone('7')})?",
        rf"{weekday}(?<d8>\d\d?)(?:\.|st|nd|rd|th|er)?[\s\-]+(?:de\s+)?{month('8')},?[\s\-]+(?:de\s+)?(?<y8>\d{{4}})(?:{_DATE_SEP}{_time('8')}{_zone('8')})?",
        rf"{weekday}{month('9')}\s+(?<d9>\d\d?)(?:st|nd|rd|th)?,?\s+(?<y9>\d{{4}})(?:{_DATE_SEP}{_time('9')}{_zone('9')})?",
        rf"{weekday}{month('10')}\s+(?<d10>\d\d?)\s+{_time('10')}{_zone('10')}\s+(?<y10>\d{{4}})",
        r"(?<y11>\d{4})[年년]\s?(?<mo11>\d\d?)[月월]\s?(?<d11>\d\d?)[日일](?:\s*(?<ap11>午前|午後|上午|下午)?\s*(?<h11>\d\d?)(?:[時时点]|:)(?<mi11>\d\d)(?:分|:)?(?:(?<s11>\d\d)秒?)?" + _zone("11") + ")?",
    ]


def compiled() -> tuple[str, str]:
    """The alternation and the replacement that lists the fields in order."""
    forms = _formats()
    pattern = r"(?s)^(?:" + "|".join(f"(?:{f})" for f in forms) + r")$"
    joined = [SEP + "".join(f"${{{f}{k}}}" for k in range(1, len(forms) + 1) if f"(?<{f}{k}>" in pattern) for f in [*FIELDS, "slash"]]
    return pattern, "".join(joined)


def known_zones(spark: SparkSession) -> list[str]:
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _once(df: DataFrame, keep: list[Column], *made: Column) -> DataFrame:
    """Keep some columns and add others through a one-row generator, a step the
    optimiser doesn't merge with its neighbours: what is used several times later
    is computed once, and no filter drags a copy of it below."""
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def normalise_timestamps(df: DataFrame, value: str, zone: str | None = None, date_order: str | None = None, out: str = "utc_micros") -> DataFrame:
    """Add ``out`` (microseconds since 1970 UTC, finer digits cut off) and
    ``<out>_form`` (``epoch``, ``zoned``, ``local``, ``date`` or null).

    ``zone`` names the column with the IANA zone of values that bring none,
    ``date_order`` the column with ``mdy`` or ``dmy`` (anything else: ``dmy``).
    Null, empty, unparsable and impossible values, and local values of rows whose
    zone is null or unknown, give null.  A repeated local time is the first of the
    two unless a standard-time abbreviation names the second; a skipped one moves
    on by the length of the jump.  Rows are neither dropped nor multiplied and
    other columns are kept; helper columns never leave the operator.
    """
    spark = df.sparkSession
    pattern, rewrite = compiled()
    zones = known_zones(spark)
    # the caller's columns take positional names meanwhile, which no helper's name can clash with
    names = df.columns
    df = df.toDF(*[f"__c{k}" for k in range(len(names))])
    at = {x: F.col(f"__c{k}") for k, x in enumerate(names)}
    kept = [(k, x) for k, x in enumerate(names) if x not in (out, f"{out}_form")]
    own = [F.col(f"__c{k}") for k, _ in kept]
    raw = at[value].cast("string")
    # blanks inside are passed once, however long they are
    blank = r"[\s\p{Z}\p{Cc}\uFEFF]"
    text = F.regexp_replace(raw, rf"^{blank}++|(?<!{blank}){blank}++$", "")
    text = F.regexp_replace(text, F.lit(pattern), F.lit(rewrite))
    site = at[zone] if zone else F.lit(None).cast("string")
    order = F.lower(F.trim(at[date_order])) if date_order else F.lit("dmy")
    work = df.select(*own, text.alias("__text"), site.alias("__site"), order.alias("__order"))
    own_helpers = [F.col("__site"), F.col("__order")]
    work = _once(work, own + own_helpers, F.when(F.col("__text").startswith(SEP), F.split("__text", SEP)).alias("__p"))

    part = {f: F.nullif(F.col("__p")[k], F.lit("")) for k, f in enumerate([*FIELDS, "slash"], 1)}
    texts = ("mon", "f", "ap", "off", "utc", "abbr", "tz", "ep", "slash")
    work = _once(work, own + own_helpers, *[(x if f in texts else x.cast("int")).alias(f"__{f}") for f, x in part.items()])
    c = {f: F.col(f"__{f}") for f in part}

    month_no = F.create_map(*[F.lit(x) for k, row in enumerate(MONTHS, 1) for w in row.split() for x in (w, k)])
    swap = c["slash"].isNotNull() & F.coalesce(F.col("__order") == "mdy", F.lit(False))
    keep = ["h", "mi", "s", "f", "ap", "off", "utc", "abbr", "tz", "ep", "y", "doy", "wk", "wd"]
    work = _once(
        work, own + [F.col("__site")], *[c[f] for f in keep],
        F.coalesce(F.when(swap, c["d"]).otherwise(c["mo"]), month_no[F.lower(c["mon"])]).alias("__mo"), F.when(swap, c["mo"]).otherwise(c["d"]).alias("__d"))

    # the day
    one = F.lit(1)
    in_month = F.when(c["mo"] == 2, F.when(_leap(c["y"]), 29).otherwise(28)).when(c["mo"].isin(4, 6, 9, 11), 30).otherwise(31)
    civil = F.when((c["mo"] >= 1) & (c["mo"] <= 12) & (c["d"] >= 1) & (c["d"] <= in_month), days_from_civil(c["y"], c["mo"], c["d"]))
    jan1 = days_from_civil(c["y"], one, one)
    ordinal = F.when((c["doy"] >= 1) & (c["doy"] <= F.when(_leap(c["y"]), 366).otherwise(365)), jan1 + c["doy"] - 1)
    dow = lambda day: F.pmod(day + 3, F.lit(7))  # noqa: E731  Monday is 0
    week1 = lambda yy: days_from_civil(yy, one, F.lit(4)) - dow(days_from_civil(yy, one, F.lit(4)))
    week_day = week1(c["y"]) + (c["wk"] - 1) * 7 + c["wd"] - 1
    week = F.when((c["wk"] >= 1) & (c["wd"] >= 1) & (c["wd"] <= 7) & (week_day < week1(c["y"] + 1)), week_day)
    day = F.when(c["y"] >= 1, F.when(c["doy"].isNotNull(), ordinal).when(c["wk"].isNotNull(), week).otherwise(civil))

    # the time of day
    half = F.lower(c["ap"])
    late = half.isin("p", "午後", "下午")
    twelve = F.when((c["h"] >= 1) & (c["h"] <= 12), (c["h"] % 12) + F.when(late, 12).otherwise(0))
    asian = half.isin("午前", "午後", "上午", "下午")
    hour = F.when(c["h"].isNull(), 0).when(half.isNull(), F.when(c["h"] <= 23, c["h"])).otherwise(F.when(asian & (c["h"] == 0), F.when(late, 12).otherwise(0)).otherwise(twelve))
    minute = F.when(F.coalesce(c["mi"], F.lit(0)) <= 59, F.coalesce(c["mi"], F.lit(0)))
    second = F.when(F.coalesce(c["s"], F.lit(0)) <= 59, F.coalesce(c["s"], F.lit(0)))
    micros = F.rpad(F.substring(F.coalesce(c["f"], F.lit("")), 1, 6), 6, "0").cast("long")

    # the zone
    digits = F.regexp_replace(c["off"], "[^0-9]", "")
    digits = F.when(F.length(digits).isin(1, 3), F.concat(F.lit("0"), digits)).otherwise(digits)
    place = F.coalesce(c["tz"], F.col("__site"))
    work = _once(
        work, own, c["off"], c["utc"], c["abbr"], c["ep"], c["h"], day.alias("__day"), (hour * 3600 + minute * 60 + second).alias("__sec"), micros.alias("__us"),
        F.rpad(digits, 6, "0").alias("__digits"), F.when(place.isin(zones), place).alias("__zone"))

    million = F.lit(1_000_000).cast("long")
    pair = lambda k: F.substring("__digits", k, 2).cast("int")
    shift = F.when((pair(1) <= 18) & (pair(3) <= 59) & (pair(5) <= 59), (pair(1) * 3600 + pair(3) * 60 + pair(5)) * F.when(c["off"].startswith("-"), -1).otherwise(1))
    work = _once(
        work, own, c["off"], c["utc"], c["abbr"], c["ep"], c["h"], F.col("__zone"), ((F.col("__day") * 86400 + F.col("__sec")) * million + F.col("__us")).alias("__at"), (shift * million).alias("__shift"))

    at, tz = F.col("__at"), F.col("__zone")
    outward = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), tz))
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(at), tz))
    rest = [F.col(x) for x in ("__off", "__utc", "__abbr", "__ep", "__h", "__zone", "__at", "__shift")]
    work = _once(work, own, *rest, first.alias("__first"))
    # the offset in force once any repeated stretch is over, and the reading of `at` under it
    after = F.col("__first") + F.lit(3 * 3_600_000_000)
    work = _once(work, own, *rest, F.col("__first"), (at - (outward(after) - after)).alias("__second"))
    repeated = (F.col("__second") > F.col("__first")) & (outward(F.col("__second")) == at)
    standard = c["abbr"].isNotNull() & ~c["abbr"].rlike(SUMMER)
    in_zone = F.when(standard & repeated, F.col("__second")).otherwise(F.col("__first"))
    lo, hi = 946_684_800, 2_208_988_800  # 2000-01-01 and 2040-01-01
    ep = c["ep"].cast("decimal(20,0)")
    count = F.when((ep >= lo) & (ep < hi), ep * 1_000_000).when((ep >= lo * 1_000) & (ep < hi * 1_000), ep * 1_000).when((ep >= lo * 1_000_000) & (ep < hi * 1_000_000), ep)
    result = F.when(c["ep"].isNotNull(), count.cast("long")).when(c["utc"].isNotNull(), at).when(c["off"].isNotNull(), at - F.col("__shift")).otherwise(in_zone)
    zoned = c["utc"].isNotNull() | c["off"].isNotNull()
    form = F.when(c["ep"].isNotNull(), "epoch").when(zoned, "zoned").when(c["h"].isNotNull(), "local").otherwise("date")
    work = _once(work, own + [F.col("__ep"), F.col("__utc"), F.col("__off"), F.col("__h")], result.alias(out))
    return work.select(*[F.col(f"__c{k}").alias(x) for k, x in kept], F.col(out), F.when(F.col(out).isNotNull(), form).alias(f"{out}_form"))


def page_timestamps(page: DataFrame, clock: DataFrame) -> DataFrame:
    """(page_id, published_at, utc_micros, utc_micros_form) for every page row.

    A site without clock row leaves its zone-free values null; of several clock
    rows of a site the smallest (tz_name, date_order) counts.  The clock side is
    one short row a site, so the planner broadcasts it when its size allows and
    otherwise joins by domain_id with adaptive skew handling."""
    sites = clock.where("domain_id is not null").groupBy("domain_id").agg(F.min(F.struct("tz_name", "date_order")).alias("__k"))
    sites = sites.select(F.col("domain_id"), F.col("__k.tz_name").alias("tz_name"), F.col("__k.date_order").alias("date_order"))
    joined = page.select("page_id", "domain_id", "published_at").join(sites, "domain_id", "left")
    return normalise_timestamps(joined, "published_at", "tz_name", "date_order").select("page_id", "published_at", "utc_micros", "utc_micros_form")
