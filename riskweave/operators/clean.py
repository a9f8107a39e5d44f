"""Cleaning (C1-C7). Order matters: dedup sees typed, not yet normalised rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.config import FILL_DEFAULTS


NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF](inity|INITY)?)\s*$"
@dataclass(frozen=True)
class DateForms:
    """What a timestamp text may look like, besides ISO.

    ``plain`` forms have one reading and are tried in turn. Each pair in
    ``two_ways`` holds the two readings of one look (day first, month first); a
    feed reads all its values by the one that reads more of them, and by the
    pair's first where both read as many."""
    plain: tuple[str, ...] = ("yyyy/MM/dd[ HH:mm[:ss]]", "yyyyMMdd[ HHmmss]", "dd-MMM-yyyy[ HH:mm[:ss]]")
    two_ways: tuple[tuple[str, str], ...] = (
        ("M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"),
        ("M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a"),
        ("d.M.yyyy[ H:mm[:ss]]", "M.d.yyyy[ H:mm[:ss]]"),
        ("d-M-yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]"))

    def ordered(self, prefer: str | None) -> tuple[tuple[str, str], ...]:
        """The pairs with the reading that wins a tie in front; ``prefer``: ``day``, ``month`` or as listed."""
        if prefer is None:
            return self.two_ways
        if prefer not in ("day", "month"):
            raise ValueError(f"prefer must be 'day' or 'month', not {prefer!r}")
        return tuple(sorted(p, key=lambda f: f[0].lower() != prefer[0]) for p in self.two_ways)


DATE_FORMS = DateForms()
# Blanks as str.strip takes them (fixed values): white space and separators of Unicode.
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def clean_amount(df: DataFrame) -> DataFrame:
    """Amount to double (bad -> null), keep amount > 0 (drops null and NaN)."""
    if "amount" not in df.columns:
        return df
    amt = F.col("amount")
    if dict(df.dtypes)["amount"] == "double":
        typed = amt
    else:                                           # a cast alone would take '1d' and '2.5f' for numbers
        typed = F.when(amt.cast("string").rlike(NUMBER), F.expr("try_cast(amount AS double)"))
    out = df.withColumn("amount", typed)
    return out.where((F.col("amount") > 0) & ~F.isnan("amount"))


def _read(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def _looks_like(text: Column, form: str) -> Column:
    """Whether a text has the form's separator after one or two digits, and a half of the day just if the form has one.
    Keeps the parser away from values it can't read."""
    half = text.rlike("(?i)[ap]m$")
    return text.rlike(rf"^\d{{1,2}}\{form[1]}\d") & (half if form.endswith(" a") else ~half)


def date_order(df: DataFrame, feed: str | None = None, forms: DateForms = DATE_FORMS,
               prefer: str | None = None) -> DataFrame:
    """The election: for each feed (or the whole table) and pair of readings, how many values each reading
    can read (``first<k>``, ``second<k>``) and whether the second one wins (``swap<k>``). One aggregate."""
    text = F.trim(F.col("timestamp").cast("string"))
    votes, wins = [], []
    for k, (a, b) in enumerate(forms.ordered(prefer)):
        seen = _looks_like(text, a)
        votes += [F.count(F.when(seen, _read(text, f))).alias(f"{n}{k}") for n, f in (("first", a), ("second", b))]
        wins.append((F.col(f"second{k}") > F.col(f"first{k}")).alias(f"swap{k}"))
    rows = df.select("timestamp", *([F.col(f"`{feed}`").alias("_feed")] if feed else []))
    return rows.groupBy(*(["_feed"] if feed else [])).agg(*votes).select("*", *wins)


def clean_timestamp(df: DataFrame, feed: str | None = None, forms: DateForms = DATE_FORMS,
                    prefer: str | None = None, strict: bool = False) -> DataFrame:
    """Timestamp to timestamp_ntz, bad -> null; the row is kept.

    ISO texts and forms with one reading are read wherever they stand. Where a
    text could be day first or month first, all texts of that look in a feed
    (a value of column ``feed``; without one, the table) are read the way that
    reads most of them. What that way can't read is a date in the other way only,
    and is read so; with ``strict`` it is bad. ``prefer`` settles ties."""
    if "timestamp" not in df.columns:
        return df
    if dict(df.dtypes)["timestamp"] == "timestamp_ntz":
        return df
    text = F.trim(F.col("timestamp").cast("string"))
    pairs = forms.ordered(prefer)
    swaps = date_order(df, feed, forms, prefer).select(
        *(["_feed"] if feed else []), F.struct(*[f"swap{k}" for k in range(len(pairs))]).alias("_swap"))
    if feed:
        # a row per feed: Spark broadcasts it where it is small, and splits a hot feed where it isn't
        rows, swap = df.join(swaps, F.col(f"`{feed}`").eqNullSafe(swaps["_feed"]), "left"), F.col("_swap")
    else:
        rows, swap = df, swaps.scalar()
    def by(first: str, second: str) -> Column:
        return _read(text, first) if strict else F.coalesce(_read(text, first), _read(text, second))
    two = [F.when(_looks_like(text, a), F.when(swap[f"swap{k}"], by(b, a)).otherwise(by(a, b))) for k, (a, b) in enumerate(pairs)]
    read = F.coalesce(F.expr("try_cast(`timestamp` AS timestamp_ntz)"), *two, *[_read(text, f) for f in forms.plain])
    return rows.select(*[read.alias(c) if c == "timestamp" else F.col(f"`{c}`") for c in df.columns])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct (nulls compare equal). Partial aggregation map-side
    collapses copies before the shuffle, so a hot group of copies is cheap."""
    return df.dropDuplicates()


def require_parties(df: DataFrame) -> DataFrame:
    """C4: drop rows without sender or receiver, only when both columns exist."""
    if "sender_id" in df.columns and "receiver_id" in df.columns:
        return df.dropna(subset=["sender_id", "receiver_id"])
    return df


def normalize_country(df: DataFrame) -> DataFrame:
    """upper(strip(country)), all white space stripped; null stays null and is filled by C6."""
    for c in ("sender_country", "receiver_country"):
        if c in df.columns:
            df = df.withColumn(c, F.upper(F.trim(F.col(c).cast("string"), F.lit(_BLANKS))))
    return df


def fill_defaults(df: DataFrame) -> DataFrame:
    """Banks and countries '', type 'Unknown', currency 'EUR' (present columns only)."""
    present = {k: v for k, v in FILL_DEFAULTS.items() if k in df.columns}
    if not present:
        return df
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(present[c])).alias(c) if c in present else F.col(c)
        for c in df.columns
    ])


def clean(df: DataFrame, feed: str | None = None, forms: DateForms = DATE_FORMS, prefer: str | None = None,
          strict: bool = False) -> DataFrame:
    """C7 = C1..C6; one shuffle (the dedup). ``feed``, ``forms``, ``prefer`` and ``strict`` are clean_timestamp's."""
    return (df.transform(clean_amount).transform(clean_timestamp, feed, forms, prefer, strict).transform(drop_exact_duplicates)
              .transform(require_parties).transform(normalize_country).transform(fill_defaults))
