"""Column and table profiles, from one table of frequencies.

Every cell is counted once by (column, value), map-side first, and the counts are staged.
All the rest is read from them: patterns are tested and texts parsed once per *distinct*
value, and types, distinct counts, moments, percentiles, outliers and top values are sums
over counted values. So the data are scanned once and their cells shuffled once, whatever
the number of columns; no column and no frequent value ends up in a single task. Only one
row per column and fact combination reaches the driver, where the type rules run.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import coerce
from ..functions.columns import apart, finite, is_boolean, is_integral, is_numeric, is_temporal, quoted
from ..functions.quantiles import column_percentiles, percentiles
from ..functions.stats import sample_skewness
from ..session import new_path
from ..specs import ColumnProfile, HIGH_CARDINALITY_RATIO, MAX_CARDINALITY, TableProfile
from ..vocabulary import COMPACT_DATE, DATE_NAME_HINTS
from . import roles

LONG_TEXT = 256  # beyond this a value is grouped by its digest
TEXT_LENGTH = 60
TEXT_WORDS = 6
PARSE_SHARE = 0.8
PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95)

MONTH_FIRST = tuple(sorted(coerce.LAYOUT_NAMES, key=lambda n: (n != coerce.ISO_LAYOUT, n.startswith("%d"))))


# --- text evidence -----------------------------------------------------------


def cells(df: DataFrame, columns: dict[str, Column], *extra: Column) -> DataFrame:
    """``position, value``: one row per non-null cell of same-typed columns."""
    tags = [F.struct(F.lit(i).alias("position"), c.alias("value")) for i, c in enumerate(columns.values())]
    tags.extend(extra)
    return df.select(F.inline(F.array(*tags))).where(F.col("value").isNotNull())


def frequencies(df: DataFrame) -> DataFrame:
    """The counted cells of a table, staged."""
    counted = counted_cells(df)
    path = new_path(df.sparkSession, "frequencies")
    counted.write.parquet(path)
    return df.sparkSession.read.schema(counted.schema).parquet(path)


def counted_cells(df: DataFrame) -> DataFrame:
    """``position, key, number, whole, stamp, n, changed, mask, length, words``: the counted
    cells of a table.

    Of the four kinds of value a row has one: trimmed text (``key``), finite doubles, whole
    numbers and truth values, points in time. Position -1 counts the rows.
    """
    none = {"text": F.lit(None).cast("string"), "number": F.lit(None).cast("double"),
            "whole": F.lit(None).cast("bigint"), "stamp": F.lit(None).cast("timestamp_ntz")}

    def tag(position: int, **value: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), *[(value.get(k, c)).alias(k) for k, c in none.items()])

    tags = [tag(-1, text=F.lit(""))]
    for i, name in enumerate(df.columns):
        if is_boolean(df, name) or is_integral(df, name):
            tags.append(tag(i, whole=quoted(name).cast("bigint")))
        elif is_numeric(df, name):
            # Adding zero folds -0.0 into 0.0.
            tags.append(tag(i, number=finite(df, name).cast("double") + F.lit(0.0)))
        elif is_temporal(df, name):
            tags.append(tag(i, stamp=quoted(name).cast("timestamp_ntz")))
        else:
            tags.append(tag(i, text=quoted(name).cast("string")))
    # Tested one by one: as one text, every number would be written out to be told apart from null.
    present = reduce(or_, [F.col(k).isNotNull() for k in none])
    return counted_texts(df.select(F.inline(F.array(*tags))).where(present), "number", "whole", "stamp")


def counted_texts(cells_: DataFrame, *others: str) -> DataFrame:
    """``position, key, others..., n, changed, mask, length, words`` per distinct trimmed value.

    A long text is keyed by its digest and its facts are taken before the
    shuffle, so document-sized cells never travel. ``changed`` counts rows that
    white-space normalisation would alter at the ends.
    """
    trimmed = cells_.select("position", "text", *others, coerce.quickly_trimmed(F.col("text")).alias("v"))
    v = F.col("v")
    is_long = F.length(v) > LONG_TEXT
    return trimmed.select(
        "position", *others,
        F.when(is_long, F.concat(F.lit("sha256:"), F.sha2(v, 256))).otherwise(v).alias("key"),
        (F.col("text") != v).cast("bigint").alias("changed"),
        # No date layout is that long, so only the other facts apply.
        F.when(is_long, apart(v, coerce.fact_bits)).alias("mask"),
        F.when(is_long, F.length(v)).alias("length"),
        F.when(is_long, apart(v, word_count)).alias("words"),
    ).groupBy("position", "key", *others).agg(
        F.count(F.lit(1)).alias("n"), F.sum("changed").alias("changed"),
        F.max("mask").alias("mask"), F.max("length").alias("length"), F.max("words").alias("words"))


def with_facts(counted: DataFrame) -> DataFrame:
    """Facts of every distinct text; inner blanks count as a change of all its rows."""
    key = F.col("key")
    known = counted.where(key.isNotNull()).select(
        "position", "key", "n", "changed",
        F.coalesce("mask", coerce.layout_bits("key").bitwiseOR(apart(key, coerce.fact_bits))).alias("mask"),
        F.coalesce("length", F.length(key)).alias("length"),
        F.coalesce("words", word_count(key)).alias("words"))
    inner = F.col("mask").bitwiseAND(1 << coerce.FACT_BIT["inner_blanks"]) != 0
    return known.withColumn("changed", F.when(inner, F.col("n")).otherwise(F.col("changed")))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


class Evidence:
    """Facts about one text column, folded from its (mask, counts) rows."""

    def __init__(self, groups: list):
        self.groups = [g for g in groups if g["blank"] is False]
        self.count = sum(g["n"] for g in self.groups)
        self.unique = sum(g["values"] for g in self.groups)
        self.changed = sum(g["changed"] for g in groups)
        self.placeholders = sum(g["n"] for g in groups if self._has(g, "placeholder"))
        self.filled = sum(g["n"] for g in groups)
        self.mean_length = sum(g["length"] for g in self.groups) / self.count if self.count else 0.0
        self.mean_words = sum(g["words"] for g in self.groups) / self.count if self.count else 0.0

    @staticmethod
    def _has(group, fact: str) -> bool:
        return bool(group["mask"] >> coerce.FACT_BIT[fact] & 1)

    def rows(self, fact: str, real_only: bool = False) -> int:
        return sum(g["n"] for g in self.groups
                   if self._has(g, fact) and not (real_only and self._has(g, "placeholder")))

    def share(self, fact: str) -> float:
        return self.rows(fact) / self.count if self.count else 0.0

    def real(self) -> int:
        """Non-null rows that are not placeholders."""
        return self.filled - self.placeholders

    def tokens_only(self) -> bool:
        return bool(self.groups) and all(self._has(g, "true") or self._has(g, "false") for g in self.groups)

    def looks_like_dates(self, name: str) -> bool:
        hint, compact = self.share("date_hint"), self.share("compact_date")
        if (hint >= 0.7 and self.share("year_hint") >= 0.5) or compact >= 0.9:
            return True
        named = any(part in name.lower() for part in DATE_NAME_HINTS)
        return named and (hint >= 0.3 or compact >= 0.5)

    def layouts(self, real_only: bool = False) -> tuple[list[str], int, int]:
        """Date layouts to try in order, the rows they parse, and those of a sane year.

        One layout must explain 80 % of the rows; the rest are then covered
        greedily, each time by the layout parsing most of what is left. Without
        such a main layout any listed one is accepted, month before day.
        """
        groups = [g for g in self.groups if not (real_only and self._has(g, "placeholder"))]
        total = sum(g["n"] for g in groups)
        if not total:
            return [], 0, 0
        any_layout = (1 << len(coerce.LAYOUT_NAMES)) - 1
        dated = [g for g in groups if g["mask"] & any_layout]
        every = sum(g["n"] for g in dated)
        sane = sum(g["n"] for g in dated if self._has(g, "sane_year"))

        def parsed(layout, among):
            bit = coerce.LAYOUT_NAMES.index(layout)
            return sum(g["n"] for g in among if g["mask"] >> bit & 1)

        main = max(coerce.LAYOUT_NAMES[:-1], key=lambda n: min(parsed(n, groups) / total, 0.99))
        if parsed(main, groups) / total < PARSE_SHARE:
            return list(MONTH_FIRST), every, sane
        chosen, left, done = [], groups, 0
        layout = main
        while layout and parsed(layout, left):
            done += parsed(layout, left)
            chosen.append(layout)
            bit = coerce.LAYOUT_NAMES.index(layout)
            left = [g for g in left if not g["mask"] >> bit & 1]
            open_ = [n for n in coerce.LAYOUT_NAMES if n not in chosen]
            layout = max(open_, key=lambda n: parsed(n, left)) if open_ and left else None
        return chosen, done, sane


def text_evidence(df: DataFrame, columns: dict[str, Column]) -> dict[str, Evidence]:
    """Evidence of every text column from one scan and one shuffle of distinct values."""
    if not columns:
        return {}
    counted = counted_texts(cells(df, columns).withColumnRenamed("value", "text"))
    return evidence_of(counted, {i: n for i, n in enumerate(columns)})[1]


def evidence_of(counted: DataFrame, names: dict[int, str]) -> tuple[int, dict[str, Evidence]]:
    """The number of rows, where they are counted, and the evidence of the columns at these positions."""
    blank = F.col("key") == ""
    rows = with_facts(counted).groupBy("position", "mask", blank.alias("blank")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.sum("changed").alias("changed"),
        F.sum(F.col("n") * F.col("length")).alias("length"), F.sum(F.col("n") * F.col("words")).alias("words")).collect()
    groups = [r.asDict() for r in rows]
    n_rows = sum(g["n"] for g in groups if g["position"] == -1)
    return n_rows, {name: Evidence([g for g in groups if g["position"] == i]) for i, name in names.items()}


def evidence_frame(spark, evidence: dict[str, Evidence], facts: Sequence[str]) -> DataFrame:
    """``column, count, unique, mean_length, mean_words`` and the share of each fact."""
    rows = [(n, e.count, e.unique, e.mean_length, e.mean_words, *[e.share(f) for f in facts])
            for n, e in evidence.items()]
    shares = "".join(f", {f}_share double" for f in facts)
    return spark.createDataFrame(
        rows, "column string, count long, unique long, mean_length double, mean_words double" + shares)


# --- typed columns -----------------------------------------------------------


def parsed_column(source: Column, inferred: str, parse: dict) -> Column:
    """A trimmed text column as its inferred type."""
    if inferred == "numeric":
        return apart(source, coerce.to_number)
    if inferred == "datetime":
        return apart(source, lambda c: coerce.to_datetime(c, parse["layouts"]))
    return coerce.to_boolean(source)


def numeric_aggs(c: Column, i: int) -> list[Column]:
    v = c.cast("double")
    n = F.count(v)
    return [
        F.struct(
            n.alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
            F.stddev(v).alias("std"), F.when(n > 2, sample_skewness(v)).alias("skew"), F.sum(v).alias("sum"),
            F.round(F.try_divide(F.count_if(v == 0) * 100.0, n), 2).alias("zero_pct"),
            F.round(F.try_divide(F.count_if(v < 0) * 100.0, n), 2).alias("negative_pct"),
        ).alias(f"num{i}")
    ]


def outlier_counts(df: DataFrame, columns: dict[str, Column], quartiles: dict) -> dict[str, int]:
    tests = {}
    for name, c in columns.items():
        q = quartiles.get(name)
        if q and q[1] > q[0]:
            reach = 1.5 * (q[1] - q[0])
            tests[name] = F.count_if((c < F.lit(q[0] - reach)) | (c > F.lit(q[1] + reach)))
    if not tests:
        return {}
    return df.agg(*[t.alias(n) for n, t in tests.items()]).first().asDict()


def suggested_grain(span: int, days: int) -> str:
    if span <= 62:
        return "day"
    if span <= 400:
        return "week" if days > 60 else "month"
    if span <= 1500:
        return "month"
    return "quarter" if span <= 4000 else "year"


def numeric_summary(df: DataFrame, columns: dict[str, Column],
                    distinct: dict[str, int] | None = None) -> dict[str, dict]:
    """Moments, percentiles and outlier count of numeric columns, on the driver."""
    if not columns:
        return {}
    names = list(columns)
    # Computed once per row, however often the aggregates refer to it.
    df = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    columns = {n: quoted(n) for n in names}
    row = df.agg(*[a for i, n in enumerate(names) for a in numeric_aggs(columns[n], i)]).first()
    out = {n: row[f"num{i}"].asDict() for i, n in enumerate(names)}
    _add_percentiles(df, columns, out, column_percentiles(df, columns, list(PERCENTS), distinct))
    return out


def _add_percentiles(df, columns, out, q):
    far = outlier_counts(df, columns, {n: (v[1], v[3]) if v else None for n, v in q.items()})
    for n in columns:
        p = q[n] or [None] * len(PERCENTS)
        out[n].update(p05=p[0], p25=p[1], median=p[2], p75=p[3], p95=p[4], outlier_count=far.get(n, 0))


# --- duplicates --------------------------------------------------------------


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of a row; nulls, empty text and column borders stay distinct."""
    names = df.columns if columns is None else columns
    floats = {n for n in names if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType))}
    # Adding zero folds -0.0 into 0.0, as grouping does.
    texts = [((quoted(n) + F.lit(0.0)) if n in floats else quoted(n)).cast("string") for n in names]
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(texts)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def duplicate_count(df: DataFrame) -> DataFrame:
    """``n_rows, n_duplicates``: rows beyond the first of each equal group.

    Only digests are shuffled, not rows, and copies combine within a task.
    """
    groups = df.groupBy(row_digest(df).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


# --- top values --------------------------------------------------------------


def top_values(df: DataFrame, columns: dict[str, Column], k: int = 12,
               counts: dict[str, int] | None = None) -> DataFrame:
    """``name, rank, value, n, pct``: the k most frequent values of each column.

    Ranking is cut to k rows per column inside each task before the shuffle.
    ``counts`` are the non-blank values per column, counted here if not known.
    """
    tagged = [F.struct(F.lit(n).alias("name"), coerce.trimmed(c.cast("string")).alias("value"))
              for n, c in columns.items()]
    values = df.select(F.inline(F.array(*tagged))).where(F.col("value").isNotNull() & (F.col("value") != ""))
    counted = values.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if counts is None:
        totals = df.agg(*[F.count_if(coerce.trimmed(c.cast("string")) != "").alias(n) for n, c in columns.items()])
        total = {n: totals.select(quoted(n)).scalar() for n in columns}
    else:
        total = {n: F.lit(counts[n]) for n in columns}
    whole = F.coalesce(*[F.when(F.col("name") == n, total[n]) for n in columns])
    return best.select("name", "rank", "value", "n",
                       F.round(F.try_divide(F.col("n") * 100.0, whole), 2).alias("pct"))


# --- the profile -------------------------------------------------------------


def profile_table(df: DataFrame, duplicates: bool = True, detail: bool = True) -> TableProfile:
    """Profile every column of a raw or typed table.

    Without ``detail`` only what cleaning needs is computed (types, roles,
    distinct counts, ends); statistics, top values and samples stay empty.
    """
    names = df.columns
    at = {n: i for i, n in enumerate(names)}
    direct = [n for n in names if is_numeric(df, n) or is_temporal(df, n) or is_boolean(df, n)]
    counted = frequencies(df)
    n_rows, evidence = evidence_of(counted, {at[n]: n for n in names if n not in direct})
    kinds = {n: "datetime" if is_temporal(df, n) else "boolean" if is_boolean(df, n) else "numeric" for n in direct}
    parse: dict[str, dict] = {}
    for n, e in evidence.items():
        kinds[n], parse[n] = _text_type(counted, n, at[n], e)

    typed = {r["position"]: r for r in counted.where(F.col("key").isNull()).groupBy("position").agg(
        F.count(F.lit(1)).alias("unique"), F.sum("n").alias("count"), F.min("whole").alias("lo"), F.max("whole").alias("hi"),
        F.sum(F.when(F.col("whole").cast("string").rlike(COMPACT_DATE), F.col("n"))).alias("dated")).collect()}
    # Whole numbers shaped like yyyymmdd are judged as the text they spell.
    for n in direct:
        r = typed.get(at[n])
        if r and is_integral(df, n) and r["hi"] >= 19000000 and r["lo"] < 21000000 and (r["dated"] or 0) >= 0.5 * r["count"]:
            spelled = counted.where(F.col("position") == at[n]).withColumn("key", F.col("whole").cast("string")).withColumn("changed", F.lit(0))
            e = evidence_of(spelled, {at[n]: n})[1][n]
            kind, how = _text_type(spelled, n, at[n], e)
            if kind == "datetime":
                kinds[n], parse[n], evidence[n] = kind, how, e
        # An integer column holding only 0 and 1 is a flag although typed.
        if r and kinds[n] == "numeric" and is_integral(df, n) and 0 <= r["lo"] and r["hi"] <= 1:
            kinds[n] = "boolean"

    numeric, dated = [n for n in names if kinds[n] == "numeric"], [n for n in names if kinds[n] == "datetime"]
    stats = _number_stats(counted, {at[n]: n for n in numeric}, detail)
    dates = _date_stats(counted, {at[n]: n for n in dated}, parse) if detail else {}
    tops, ends = {n: [] for n in names}, {}
    if detail:
        counts = {n: evidence[n].count if n in evidence else typed[at[n]]["count"] if at[n] in typed else 0 for n in names}
        tops = _tops(counted, df, kinds, evidence, at, counts)
        ends = _text_ends(counted, df, [n for n in names if kinds[n] in ("categorical", "text")], at)
        ends |= {n: (s["min"], s["max"]) for n, s in stats.items()} | {n: (d["min"], d["max"]) for n, d in dates.items()}

    columns = []
    for n in names:
        e, r = evidence.get(n), typed.get(at[n])
        count = e.count if e else r["count"] if r else 0
        unique = stats[n].pop("unique") if kinds[n] == "numeric" and n in stats else e.unique if e else r["unique"] if r else 0
        missing = n_rows - count
        c = ColumnProfile(
            name=n, physical_type=df.schema[n].dataType.simpleString(), inferred_type=kinds[n],
            count=count, missing=missing, missing_pct=round(missing / n_rows * 100, 2) if n_rows else 0.0,
            unique=unique, cardinality_ratio=round(unique / count, 4) if count else 0.0,
            is_constant=unique <= 1 and count > 0,
            is_unique_key=unique == n_rows and n_rows > 1 and missing == 0,
            numeric=stats.get(n) or (None if detail or kinds[n] != "numeric" else {"min": None, "max": None}),
            datetime=dates.get(n, {}) if detail and kinds[n] == "datetime" else None,
            top_values=tops[n], sample_values=_samples(ends.get(n), tops[n]) if detail else [],
            parse={**parse.get(n, {}), "evidence": e},
        )
        facts = {f: e.share(f) for f in ("uuid", "email", "percent", "currency")} if e else {}
        c.role, c.role_confidence, c.role_evidence = roles.infer_role(c, facts)
        columns.append(c)

    repeated = duplicate_count(df).first()["n_duplicates"] if duplicates else None
    domain, signals = roles.guess_domain(names)
    profile = TableProfile(n_rows, repeated, columns, domain=domain, domain_signals=signals)
    roles.pick_primaries(profile)
    return profile


def typical_decimals(df: DataFrame) -> DataFrame:
    """``column, decimals``: how many digits most values of a column have after the point, at
    most six; of equally many rows the fewer digits. Values without a point do not count, and
    columns without any have 0."""
    # A double's digits as it is written, of which there is one at least.
    written = F.rtrim(F.col("number").cast("decimal(38,10)").cast("string"), F.lit("0"))
    written = F.when(written.endswith("."), F.concat(written, F.lit("0"))).otherwise(written)
    digits = F.length(F.regexp_extract(F.coalesce(F.col("key"), written, F.lit("")), r"\.([0-9]+)$", 1))
    by_digits = frequencies(df).where("position >= 0").groupBy("position", digits.alias("_digits")).agg(F.sum("n").alias("n"))
    best = by_digits.where("_digits > 0").groupBy("position").agg(F.max_by("_digits", F.struct("n", -F.col("_digits"))).alias("decimals"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, column string")
    return names.join(best, "position", "left").orderBy("position").select(
        "column", F.least(F.coalesce("decimals", F.lit(0)), F.lit(6)).cast("int").alias("decimals"))


def _by_position(values: dict[int, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("position") == i, c) for i, c in values.items()])


def _number_stats(counted: DataFrame, names: dict[int, str], detail: bool) -> dict[str, dict]:
    """Distinct values and ends, in detail also moments, percentiles and outliers, by counted values."""
    if not names:
        return {}
    spelled = F.col("key").isNotNull()
    value = F.when(spelled, apart(F.col("key"), coerce.to_number)).otherwise(F.coalesce(F.col("number"), F.col("whole").cast("double")))
    numbers = counted.where(F.col("position").isin(*names)).select("position", "whole", value.alias("v"), "n").where("v is not null")
    # Whole numbers stay apart beyond 2 ** 53, where doubles meet.
    numbers = numbers.groupBy("position", "whole", "v").agg(F.sum("n").alias("n"))
    if detail:
        path = new_path(counted.sparkSession, "numbers")
        numbers.write.parquet(path)
        numbers = counted.sparkSession.read.schema(numbers.schema).parquet(path)
    v, n = F.col("v"), F.col("n")
    plain = numbers.groupBy("position").agg(
        F.count(F.lit(1)).alias("unique"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("n").alias("rows"),
        F.sum(v * n).alias("sum"), F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"), F.sum(F.when(v < 0, n).otherwise(0)).alias("below"))
    base = {names[r["position"]]: r.asDict() for r in plain.collect()}
    if not detail:
        return {name: {k: r[k] for k in ("unique", "min", "max")} for name, r in base.items()}
    found = [i for i, name in names.items() if name in base]
    if not found:
        return {}
    mean = _by_position({i: F.lit(base[names[i]]["sum"] / base[names[i]]["rows"]) for i in found})
    quantiles = {r["position"]: r["p"] for r in percentiles(
        numbers, v, list(PERCENTS), {"position": F.col("position")}, max(r["unique"] for r in base.values()), weight=n).collect()}
    reach = {i: 1.5 * (quantiles[i][3] - quantiles[i][1]) for i in found}
    fence = [i for i in found if reach[i] > 0] or found[:1]
    out_low = _by_position({i: F.lit(quantiles[i][1] - reach[i]) for i in fence})
    out_high = _by_position({i: F.lit(quantiles[i][3] + reach[i]) for i in fence})
    far = F.sum(F.when((v < F.col("_low")) | (v > F.col("_high")), n).otherwise(0))
    moved = numbers.select("position", "v", "n", (v - mean).alias("_d"), out_low.alias("_low"), out_high.alias("_high"))
    d = F.col("_d")
    central = moved.groupBy("position").agg(F.sum(n * d * d).alias("m2"), F.sum(n * d * d * d).alias("m3"), far.alias("far")).collect()
    out = {}
    for r in central:
        name, i = names[r["position"]], r["position"]
        b, p, rows = base[name], quantiles[i], base[name]["rows"]
        spread = (r["m2"] / rows) ** 0.5
        skew = r["m3"] / rows / spread / spread / spread * (rows * (rows - 1)) ** 0.5 / (rows - 2) if rows > 2 and spread > 0 else None
        out[name] = {
            "unique": b["unique"], "n": rows, "min": b["min"], "max": b["max"], "mean": b["sum"] / rows,
            "std": (r["m2"] / (rows - 1)) ** 0.5 if rows > 1 else None, "skew": skew, "sum": b["sum"],
            "zero_pct": _percent(b["zeros"], rows), "negative_pct": _percent(b["below"], rows),
            "p05": p[0], "p25": p[1], "median": p[2], "p75": p[3], "p95": p[4], "outlier_count": r["far"] if reach[i] > 0 else 0}
    return out


def _percent(part: int, whole: int) -> float:
    """With two digits, halves up."""
    return math.floor(part * 10_000.0 / whole + 0.5) / 100


def _date_stats(counted: DataFrame, names: dict[int, str], parse: dict) -> dict[str, dict]:
    if not names:
        return {}
    spelled = F.coalesce(F.col("key"), F.col("whole").cast("string"))
    read = {i: parsed_column(spelled, "datetime", parse[n]) for i, n in names.items() if n in parse}
    stamp = F.coalesce(F.col("stamp"), _by_position(read)) if read else F.col("stamp")
    days = counted.where(F.col("position").isin(*names)).select("position", stamp.cast("timestamp_ntz").alias("t")).where("t is not null").groupBy(
        "position", F.unix_date(F.col("t").cast("date")).alias("day")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ends = days.groupBy("position").agg(F.min("lo").alias("min"), F.max("hi").alias("max"), F.count(F.lit(1)).alias("days"))
    rows = ends.withColumn("span", F.timestamp_diff("DAY", F.col("min"), F.col("max"))).collect()
    return {names[r["position"]]: {"min": r["min"], "max": r["max"], "range_days": r["span"], "distinct_days": r["days"],
                                   "suggested_grain": suggested_grain(r["span"], r["days"])} for r in rows}


def _tops(counted: DataFrame, df: DataFrame, kinds: dict, evidence: dict, at: dict, counts: dict, k: int = 12) -> dict[str, list]:
    """The most frequent labels of each column that has labels; cut to k rows per task before the shuffle."""
    listed = [n for n in df.columns if kinds[n] in ("categorical", "boolean") or (kinds[n] == "text" and evidence[n].unique <= MAX_CARDINALITY)]
    tops: dict[str, list] = {n: [] for n in df.columns}
    if not listed:
        return tops
    truth = [at[n] for n in listed if is_boolean(df, n)]
    whole = F.when(F.col("position").isin(*truth), (F.col("whole") == 1).cast("string")).otherwise(F.col("whole").cast("string"))
    labels = counted.where(F.col("position").isin(*[at[n] for n in listed])).select(
        "position", F.coalesce(F.col("key"), whole, F.col("number").cast("string")).alias("value"), "n").where(F.col("value") != "")
    order = Window.partitionBy("position").orderBy(F.desc("n"), "value")
    best = labels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    name_at = {i: n for n, i in at.items()}
    for r in sorted(best.collect(), key=lambda r: (r["position"], r["rank"])):
        name = name_at[r["position"]]
        if kinds[name] != "text" or r["rank"] <= 8:
            tops[name].append((r["value"], r["n"], _percent(r["n"], counts[name])))
    return tops


def _text_ends(counted: DataFrame, df: DataFrame, names: list[str], at: dict) -> dict[str, tuple]:
    """First and last text of each column; those with digests for texts are read again."""
    if not names:
        return {}
    rows = counted.where(F.col("position").isin(*[at[n] for n in names]) & (F.col("key") != "")).groupBy("position").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("length").alias("long")).collect()
    found = {r["position"]: r for r in rows}
    ends = {n: (found[at[n]]["lo"], found[at[n]]["hi"]) for n in names if at[n] in found}
    digested = [n for n in ends if found[at[n]]["long"] is not None]
    if digested:
        tidy = df.select(*[coerce.trimmed(quoted(n).cast("string")).alias(n) for n in digested])
        shown = {n: F.when(quoted(n) != "", quoted(n)) for n in digested}
        row = tidy.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(n) for n, c in shown.items()]).first()
        ends |= {n: (row[n]["lo"], row[n]["hi"]) for n in digested}
    return ends


def _text_type(counted: DataFrame, name: str, position: int, e: Evidence) -> tuple[str, dict]:
    if not e.count:
        return "empty", {}
    if e.tokens_only() and (e.unique <= 4 or _spellings(counted, position) <= 4):
        return "boolean", {}
    if e.looks_like_dates(name):
        layouts, rows, sane = e.layouts()
        if rows / e.count >= PARSE_SHARE and sane / rows >= PARSE_SHARE:
            return "datetime", {"layouts": layouts}
    if e.share("number") >= PARSE_SHARE:
        return "numeric", {}
    varied = e.unique > MAX_CARDINALITY and e.unique / e.count > HIGH_CARDINALITY_RATIO
    wordy = e.mean_length > TEXT_LENGTH or e.mean_words > TEXT_WORDS
    return "text" if varied or wordy else "categorical", {}


def _spellings(counted: DataFrame, position: int) -> int:
    """Distinct case-folded tokens; at most the size of the token lists."""
    token = F.when(F.col("key") != "", F.lower("key"))
    return counted.where(F.col("position") == position).select(token.alias("t")).distinct().agg(F.count("t")).first()[0]


def _samples(ends: tuple | None, tops: list) -> list[str]:
    if tops:
        return [v for v, _, _ in tops[:5]]
    return list(dict.fromkeys(str(v) for v in ends or () if v is not None))


# --- profile tables ----------------------------------------------------------

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("position", T.IntegerType()),
    T.StructField("physical_type", T.StringType()), T.StructField("inferred_type", T.StringType()),
    T.StructField("semantic_role", T.StringType()), T.StructField("role_confidence", T.DoubleType()),
    T.StructField("role_evidence", T.ArrayType(T.StringType())),
    T.StructField("count", T.LongType()), T.StructField("missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()), T.StructField("unique", T.LongType()),
    T.StructField("cardinality_ratio", T.DoubleType()), T.StructField("is_constant", T.BooleanType()),
    T.StructField("is_unique_key", T.BooleanType()),
    T.StructField("numeric", T.StructType(
        [T.StructField(n, T.DoubleType()) for n in (
            "min", "max", "mean", "median", "std", "p05", "p25", "p75", "p95", "skew", "sum",
            "zero_pct", "negative_pct")] + [T.StructField("outlier_count", T.LongType())])),
    T.StructField("datetime", T.StructType([
        T.StructField("min", T.TimestampNTZType()), T.StructField("max", T.TimestampNTZType()),
        T.StructField("range_days", T.LongType()), T.StructField("distinct_days", T.LongType()),
        T.StructField("suggested_grain", T.StringType())])),
    T.StructField("top_values", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("count", T.LongType()),
        T.StructField("pct", T.DoubleType())]))),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])


def profile_frame(spark, profile: TableProfile) -> DataFrame:
    """One row per column."""
    number_names = PROFILE_SCHEMA["numeric"].dataType.names
    date_names = PROFILE_SCHEMA["datetime"].dataType.names
    rows = []
    for i, c in enumerate(profile.columns):
        number = tuple((c.numeric or {}).get(n) for n in number_names) if c.numeric else None
        dated = tuple((c.datetime or {}).get(n) for n in date_names) if c.datetime else None
        rows.append((
            c.name, i, c.physical_type, c.inferred_type, c.role, c.role_confidence, c.role_evidence,
            c.count, c.missing, c.missing_pct, c.unique, c.cardinality_ratio, c.is_constant, c.is_unique_key,
            number, dated, c.top_values, c.sample_values))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def dataset_profile(spark, profile: TableProfile) -> DataFrame:
    """One row for the whole table."""
    schema = ("n_rows long, n_columns int, n_duplicate_rows long, numeric_columns string, "
              "categorical_columns string, datetime_columns string, boolean_columns string, text_columns string, "
              "identifier_columns string, measure_columns string, dimension_columns string, "
              "primary_date string, primary_measure string, domain string")
    lists = [profile.names(k) for k in ("numeric", "categorical", "datetime", "boolean", "text")]
    lists += [profile.identifiers, profile.measures, profile.dimensions]
    row = (profile.n_rows, len(profile.columns), profile.n_duplicates, *[",".join(v) for v in lists],
           profile.primary_date, profile.primary_measure, profile.domain)
    return spark.createDataFrame([row], schema)
