"""Files of a benchmark run and of graph collections: attempt records, metadata, fingerprints, candidates and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_cell
from ..operators import runs

#: The columns that metadata must have.
REQUIRED = ("dataset", "nodes", "edges", "file_size_bytes", "bfs_source")
#: Kinds of graph files, by preference.
PREFERENCE = {"mtx": 0, "edges": 1, "txt": 2, "csv": 3, "tsv": 3, "out": 4, "dat": 5}
#: The graphs that are usually measured, by the collection that offers them, in order.
SNAP = "cit-HepPh soc-Epinions1 soc-Slashdot0811 web-NotreDame web-Stanford web-Google roadNet-CA soc-LiveJournal1".split()
NETWORK_REPOSITORY = (
    "ia-enron-email-dynamic tech-RL-caida soc-themarker socfb-Harvard1 socfb-Oklahoma97 socfb-Indiana69 socfb-Penn94 socfb-UF21 socfb-Texas84 soc-BlogCatalog soc-LiveMocha soc-buzznet soc-flickr soc-catster"
).split()


def scan_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The attempt records of all JSON files below ``folder``; texts that are none stay as rows with ``bad``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return runs.parse_attempts(files.select(F.col("_metadata.file_path").alias("record_path"), "value"))


def collect_attempts(spark: SparkSession, folder: str, expected: DataFrame, mpi_ranks: int = 2) -> tuple[DataFrame, DataFrame]:
    """The valid records, and the invalid ones as evidence (record_path, record_id, phase, reason)."""
    records = scan_attempts(spark, folder)
    invalid = runs.invalid_attempts(records, expected, mpi_ranks)
    return records.where("not bad").join(invalid.select("record_path"), "record_path", "left_anti"), invalid


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata file as text columns; raises if a column is missing, a dataset has no name or comes twice."""
    rows = spark.read.csv(path, header=True)
    missing = sorted(set(REQUIRED) - set(rows.columns))
    if missing:
        raise ValueError(f"metadata lacks the columns {', '.join(missing)}")
    rows = rows.withColumn("dataset", F.trim("dataset"))
    found = rows.groupBy("dataset").agg(F.count("*").alias("n")).agg(F.count_if(F.coalesce(F.col("dataset"), F.lit("")) == "").alias("unnamed"), F.min(F.when(F.col("n") > 1, F.col("dataset"))).alias("twice")).first()
    if found["unnamed"]:
        raise ValueError("metadata has a row without a dataset")
    if found["twice"]:
        raise ValueError(f"metadata has the dataset {found['twice']} more than once")
    return rows


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, modified) of the files below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, modified, digest): each file by its SHA-256; a file has to fit into a cell, 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def discover_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset) of the MatrixMarket files below ``folder``."""
    return list_files(spark, folder, "*.mtx").select(file_stem(F.col("path")).alias("dataset"))


def candidate_files(files: DataFrame) -> DataFrame:
    """(path, size_bytes, kind, preference) of the files that may hold a graph; smaller preference first, then larger files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rank = F.create_map(*[F.lit(x) for item in PREFERENCE.items() for x in item])[kind]
    rows = files.withColumns({"kind": kind, "preference": rank})
    named = ~F.startswith(name, F.lit(".")) & ~F.lower(name).rlike("readme|meta")
    return rows.where(named & F.col("preference").isNotNull()).select("path", "size_bytes", "kind", "preference")


def best_candidate(files: DataFrame) -> DataFrame:
    """The one file to read; no row if there is none."""
    return candidate_files(files).orderBy("preference", F.desc("size_bytes"), "path").limit(1)


def catalog(spark: SparkSession) -> DataFrame:
    """(dataset, page_url, direct_url): where the usual graphs are to be had."""
    snap = [(n, f"https://snap.stanford.edu/data/{n}.html", f"https://snap.stanford.edu/data/{n}.txt.gz") for n in SNAP]
    other = [(n, f"https://networkrepository.com/{n}.php", None) for n in NETWORK_REPOSITORY]
    return spark.createDataFrame(snap + other, "dataset string, page_url string, direct_url string")


def archive_choice(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """(dataset, url): the direct URL, else the best archive that the page links to, else the usual place.

    ``links`` has (page_url, url, place); of archives of a kind, the first on the page counts.
    """
    low = F.lower("url")
    rank = F.when(low.rlike(r"nrvis\.com.*\.zip$"), 0).when(F.endswith(low, F.lit(".zip")), 1).when(F.endswith(low, F.lit(".gz")), 2).when(low.rlike(r"\.(7z|bz2)$"), 3)
    best = links.withColumn("rank", rank).where("rank is not null").groupBy("page_url").agg(F.min_by("url", F.struct("rank", "place")).alias("found"))
    usual = F.concat(F.lit("https://nrvis.com/download/data/"), F.substring("dataset", 1, 3), F.lit("/"), F.col("dataset"), F.lit(".zip"))
    return catalog.join(best, "page_url", "left").select("dataset", F.coalesce("direct_url", "found", usual).alias("url"))


def check_config(config: dict) -> list[str]:
    """What is wrong with the description of an experiment; empty if nothing is."""
    errors = []
    for name in ("datasets", "algorithms", "methods"):
        values = config.get(name)
        if not isinstance(values, list) or not values or not all(isinstance(v, str) for v in values):
            errors.append(f"{name}: a list of names is needed")
        elif len(set(values)) < len(values):
            errors.append(f"{name}: names come twice")
    for name, known in (("algorithms", runs.ALGORITHMS), ("methods", runs.METHODS)):
        values = config.get(name)
        unknown = sorted(set(values) - set(known)) if isinstance(values, list) and all(isinstance(v, str) for v in values) else []
        errors += [f"{name}: unknown {v}" for v in unknown]
    for name, least in (("repeat", 1), ("warmup", 0), ("timeout_s", 1), ("mpi_ranks", 2)):
        if type(config.get(name)) is not int or config[name] < least:
            errors.append(f"{name}: an integer of at least {least} is needed")
    numbers = config.get("parameters") if isinstance(config.get("parameters"), dict) else {}
    errors += [f"parameters.{name}: a number is needed" for name in ("k", "alpha", "beta", "threshold") if type(numbers.get(name)) not in (int, float)]
    launcher = config.get("launcher") if isinstance(config.get("launcher"), dict) else {}
    errors += [f"launcher.{name}: a text is needed" for name in ("command", "ranks_flag") if not launcher.get(name) or not isinstance(launcher[name], str)]
    methods = config.get("methods") if isinstance(config.get("methods"), list) else []
    errors += [f"methods: {a} and {b} go together" for a, b in runs.MODES.values() if (a in methods) != (b in methods)]
    return errors


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    """A file with a header; committed as a whole, so that a reader never meets half of it."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, sep=separator)


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as a row of a Markdown table."""
    cells = [markdown_cell(F.col(c)) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def environment(spark: SparkSession) -> DataFrame:
    """One row: where and with what a run is made."""
    import platform

    seen = (platform.node(), platform.python_version(), spark.version, spark.sparkContext.master)
    return spark.createDataFrame([seen], "hostname string, python string, spark string, master string").withColumn("recorded_at", F.current_timestamp())
