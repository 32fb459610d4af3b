"""Cleaning of tagged records: values, cells, circuits, duplicates, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words and marks that tags may hold, with what they stand for, in the order of their replacement.
TAG_WORDS = {
    "voltage": [
        ("400/220/110 kV'", "400000;220000;110000"), ("400/220/110/20_kv", "400000;220000;110000;20000"), ("2x25000", "25000;25000"), ("é", ";"), ("kvv/", ""), ("11000l400", "11000"),
        ("(temp 150000)", ""), ("low", "1000"), ("minor", "1000"), ("medium", "33000"), ("med", "33000"), ("m", "33000"), ("high", "150000"), ("23000-109000", "109000"),
        ("380000>220000", "380000;220000"), (":", ";"), ("<", ";"), (",", ";"), ("kv", "000"), ("kva", "000"), ("/", ";"), ("nan", ""), ("<na>", ""),
    ],
    "circuits": [("partial", ""), ("1operator=rte operator:wikidata=q2178795", ""), ("1,5", "3"), ("1/3", "1"), ("<na>", ""), ("nan", "")],
    "cables": [("1/3", "1"), ("3x2;2", "3"), ("<na>", ""), ("nan", "")],
    "wires": [
        ("?", ""), ("trzyprzewodowe", "3"), ("pojedyńcze", "1"), ("single", "1"), ("double", "2"), ("triple", "3"), ("quad", "4"), ("fivefold", "5"), ("yes", "3"), ("1/3", "1"), ("3x2;2", "3"),
        ("_", ""), ("<na>", ""), ("nan", ""),
    ],
    "frequency": [("16.67", "16.7"), ("16,7", "16.7"), ("?", ""), ("hz", ""), (" ", ""), ("<na>", ""), ("nan", "")],
}


def clean_numbers(value: Column, kind: str = "voltage") -> Column:
    """Lower case, the kind's literal replacements in order, then everything but digits and ;
    (and the point, for frequencies) dropped.  NULL is an empty text, as it is for a missing tag."""
    v = F.lower(F.coalesce(value, F.lit("")))
    for old, new in TAG_WORDS[kind]:
        v = F.replace(v, F.lit(old), F.lit(new))
    return F.regexp_replace(v, "[^0-9;.]" if kind == "frequency" else "[^0-9;]", "")


def circuit_ladder(df: DataFrame) -> DataFrame:
    """``circuits`` and ``frequency`` of split line records (id, cables, circuits, frequency,
    voltage_original, split_elements): the first rule that holds decides.

    Neither cables nor circuits: 1; one cable count on an unsplit line: whole circuits of 3
    cables (2 for direct current), 1 at least; one circuit count on an unsplit line: itself;
    several voltages but single counts: the circuits, or cables over 3, dealt over the
    voltages; as many circuits (cables) as elements: the element's own; else 1.
    """
    dc = F.col("frequency") == "0"
    freq = F.when(dc, "0").otherwise("50")
    n = lambda c: F.size(F.split(c, ";"))
    cables, circuits = F.col("cables"), F.col("circuits")
    at = F.element_at(F.split("id", "-"), -1).try_cast("int")
    own = lambda c: F.get(F.split(c, ";"), at - 1).try_cast("int")
    one = F.col("split_elements") == 1
    whole = lambda x, k: F.greatest(F.floor(x / k), F.lit(1)).cast("int").cast("string")
    dealt = F.coalesce(F.when(circuits != "", circuits.try_cast("int")), F.floor(cables.try_cast("int") / 3).cast("int"))
    rule = (
        F.when((cables == "") & (circuits == ""), F.struct(F.lit("1").alias("c"), F.when(F.col("frequency").isin("50", "0"), F.col("frequency")).otherwise("50").alias("f")))
        .when((cables != "") & one & (cables != "0") & (n("cables") == 1) & (circuits == ""), F.struct(F.when(dc, whole(cables.try_cast("int"), 2)).otherwise(whole(cables.try_cast("int"), 3)).alias("c"), freq.alias("f")))
        .when((circuits != "") & one & (circuits != "0") & (n("circuits") == 1), F.struct(circuits.alias("c"), freq.alias("f")))
        .when((n("voltage_original") > 1) & (n("cables") == 1) & (n("circuits") == 1), F.struct(whole(dealt, n("voltage_original")).alias("c"), freq.alias("f")))
        .when((n("circuits") > 1) & (n("circuits") == F.col("split_elements")), F.struct(own("circuits").cast("string").alias("c"), freq.alias("f")))
        .when((n("cables") > 1) & (n("cables") == F.col("split_elements")), F.struct(whole(own("cables"), 3).alias("c"), freq.alias("f")))
        .otherwise(F.struct(F.lit("1").alias("c"), freq.alias("f")))
    )
    d = df.withColumn("_r", rule)
    return d.select(*[F.col("_r.c").alias(c) if c == "circuits" else F.col("_r.f").alias(c) if c == "frequency" else F.col(c) for c in df.columns])


def split_cells(df: DataFrame, id_col: str, cols: list[str], sep: str = ";") -> DataFrame:
    """One row per value of multi-value cells, side by side; the id gets -1, -2, ... if there
    are several."""
    arrays = F.arrays_zip(*[F.split(c, sep).alias(c) for c in cols])
    d = df.withColumn("_n", F.greatest(*[F.size(F.split(c, sep)) for c in cols]) if len(cols) > 1 else F.size(F.split(cols[0], sep)))
    d = d.select(*[c for c in df.columns if c not in cols], "_n", F.posexplode(arrays).alias("_pos", "_z"))
    name = F.when(F.col("_n") > 1, F.concat(F.col(id_col).cast("string"), F.lit("-"), (F.col("_pos") + 1).cast("string"))).otherwise(F.col(id_col).cast("string"))
    return d.select(*[name.alias(c) if c == id_col else F.col(f"_z.{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def any_at_least(value: Column, least: int, sep: str = ";") -> Column:
    return F.exists(F.split(value, sep), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(-1)) >= least)


def dedup_concat(df: DataFrame, id_col: str, joined: str, rest: list[str], sep: str = ";") -> DataFrame:
    """One row per id; the joined column lists its distinct values, sorted."""
    return df.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set(joined)), sep).alias(joined), *[F.min(c).alias(c) for c in rest])


def suffix_names(df: DataFrame, key: list[str], name: str, order: list) -> DataFrame:
    """Rows after the first of their key get " 2", " 3", ... behind the name."""
    rn = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rn).withColumn(name, F.when(F.col("_rn") > 1, F.concat(name, F.lit(" "), F.col("_rn").cast("string"))).otherwise(F.col(name))).drop("_rn")


def repair_gas(df: DataFrame) -> DataFrame:
    """Natural gas plants: steam turbines and unknown technologies are CCGT, engines OCGT."""
    gas = F.col("Fueltype") == "Natural Gas"
    tech = (
        F.when(gas & (F.col("Technology").isin("Steam Turbine", "Not Found") | F.col("Technology").isNull()), "CCGT")
        .when(gas & (F.col("Technology") == "Combustion Engine"), "OCGT").otherwise(F.col("Technology"))
    )
    return df.withColumn("Technology", tech)


def gas_fuel(df: DataFrame) -> DataFrame:
    """Gas turbines by technology burn natural gas, whatever their fuel says."""
    return df.withColumn("Fueltype", F.when(F.col("Technology").isin("OCGT", "CCGT"), "Natural Gas").otherwise(F.col("Fueltype")))


def one_hot_tags(df: DataFrame, id_cols: list[str], tags: str, names: list[str]) -> DataFrame:
    """Space-separated tags as boolean columns."""
    have = F.split(tags, " ")
    return df.select(*id_cols, *[F.array_contains(have, n).alias(n.replace("-", "_")) for n in names])


#: Tags that a registry row may have, and sources in their order.
TAGS = ("latest", "supported", "not-supported", "deprecated", "might-work", "not-tested", "broken-link")
SOURCES = ("primary", "archive", "build")


def _natural(version: Column) -> Column:
    """A version as an array of its runs of digits, padded, and other characters, lower case."""
    parts = F.regexp_extract_all(F.lower(version), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(F.concat(F.lit("~"), x)))


def registry_faults(df: DataFrame) -> DataFrame:
    """Violations of the dataset registry's rules: rule, dataset, source, n.

    Rows (with ``pos``, their place in the file) must be unique by dataset, version and source;
    archive rows have a url; a dataset and source with a latest row has exactly one; latest
    versions of a dataset agree over its sources unless unknown; versions, tags, sources,
    dates and urls have their form; rows are sorted by dataset, version falling in natural
    order, and source.
    """
    has = lambda t: F.array_contains(F.split("tags", " +"), t)
    n = F.count("*").alias("n")

    def bad(rule: str, where: Column) -> DataFrame:
        return df.where(where).groupBy("dataset", "source").agg(n).select(F.lit(rule).alias("rule"), "dataset", "source", "n")

    dup = df.groupBy("dataset", "version", "source").agg(n).where("n > 1").select(F.lit("repeated").alias("rule"), "dataset", "source", "n")
    latest = df.where(has("latest")).groupBy("dataset", "source").agg(n).where("n > 1").select(F.lit("latest").alias("rule"), "dataset", "source", "n")
    differ = df.where(has("latest") & (F.col("version") != "unknown")).groupBy("dataset").agg(F.countDistinct("version").alias("n")).where("n > 1").select(F.lit("latest differs").alias("rule"), "dataset", F.lit("").alias("source"), "n")
    # The next row of the file in each range of places; a window by dataset sees all but the first rows of datasets.
    place = {s: i for i, s in enumerate(SOURCES)}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("source"))
    w = W.partitionBy("dataset").orderBy("pos")
    d = df.withColumns({"_v": _natural(F.col("version")), "_s": rank})
    d = d.withColumns({"_pv": F.lag("_v").over(w), "_ps": F.lag("_s").over(w)})
    late = d.where("_pv IS NOT NULL AND (_pv < _v OR (_pv = _v AND _ps > _s))").groupBy("dataset").agg(n).select(F.lit("order").alias("rule"), "dataset", F.lit("").alias("source"), "n")
    spans = df.groupBy("dataset").agg(F.min("pos").alias("a"), F.max("pos").alias("z"), n)
    split = spans.where("z - a + 1 <> n").select(F.lit("scattered").alias("rule"), "dataset", F.lit("").alias("source"), "n")
    tags = F.size(F.array_except(F.filter(F.split("tags", " +"), lambda x: x != ""), F.array(*map(F.lit, TAGS)))) > 0
    out = dup.unionByName(latest).unionByName(differ).unionByName(late).unionByName(split)
    for rule, where in (
        ("no url", (F.col("source") == "archive") & (F.coalesce("url", F.lit("")) == "")), ("version", ~F.col("version").rlike(r"^[a-z0-9_\-\.]+$")), ("tag", tags),
        ("source", ~F.col("source").isin(*SOURCES)), ("date", ~F.col("added").rlike(r"^\d{4}-\d{2}-\d{2}$")), ("url", ~F.coalesce("url", F.lit("")).rlike(r'^(https?://[^:\s<>"|*]*)?$')),
    ):
        out = out.unionByName(bad(rule, where))
    return out


def resolve_version(df: DataFrame, dataset: str, source: str, version: str = "latest") -> DataFrame:
    """The one supported registry row asked for, ``latest`` by tag; none or several are an error."""
    has = lambda t: F.array_contains(F.split("tags", " +"), t)
    d = df.where((F.col("dataset") == dataset) & (F.col("source") == source) & has("supported"))
    d = d.where(has("latest") if version == "latest" else F.col("version") == version)
    n = F.count("*").over(W.partitionBy("dataset"))
    one = d.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"several rows for {dataset} {version} from {source}")).cast("boolean"))).drop("_n")
    if not one.take(1):
        raise ValueError(f"no supported {version} of {dataset} from {source}")
    return one.withColumn("folder", F.concat_ws("/", F.lit("data"), "dataset", "source", "version"))
