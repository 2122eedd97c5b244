"""Readers and writers of feature, chord, section, sequence and graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JAMS = "struct<annotations:array<struct<data:array<struct<time:double,duration:double,value:string>>>>>"


def whole_files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """path, version, text of every file under a folder; versions count by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*.{suffix}")
    files = reader.load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    ranks = files.select("path").withColumn("version", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))
    return files.join(ranks, "path").select("path", "version", "text")


def repaired(text: Column) -> Column:
    """JSON whose strings hold bare quotes or lone backslashes: quotes that neither open
    nor close a string, and backslashes before no escape, are escaped."""
    out = F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.regexp_replace(out, r'(?<![\[{,:]\s{0,8})(?<!\\)"(?!\s*[,:}\]])', r'\\"')


def jams_events(files: DataFrame) -> DataFrame:
    """version, i, time, duration, value; files that are no JSON give no rows."""
    parsed = F.from_json(repaired(F.col("text")), JAMS)
    d = files.select("version", F.posexplode(parsed["annotations"][0]["data"]).alias("i", "e"))
    return d.select("version", F.col("i").cast("long").alias("i"), "e.time", "e.duration", "e.value")


def beats(files: DataFrame, *, downbeats: bool = False) -> DataFrame:
    """version, time of tab-separated beats (time, number); only number 1 if asked for.
    Lines that hold no number are left out."""
    lines = files.select("version", F.explode(F.split("text", r"\r?\n")).alias("line"))
    parts = F.split("line", "\t")
    rows = lines.select("version", F.expr("try_cast(trim(split(line, '\t')[0]) AS double)").alias("time"), F.trim(F.get(parts, 1)).alias("number"))
    rows = rows.where(F.col("time").isNotNull() & ~F.isnan("time"))
    return (rows.where("number = '1'") if downbeats else rows).select("version", "time")


def summary_fields(files: DataFrame) -> DataFrame:
    """version, beats, tuning, key, scale of summary files."""
    schema = "struct<rhythm:struct<beats_position:array<double>>,tonal:struct<tuning_frequency:double,chords_key:string,chords_scale:string>>"
    j = files.select("version", F.from_json("text", schema).alias("j"))
    return j.select("version", F.col("j.rhythm.beats_position").alias("beats"), F.col("j.tonal.tuning_frequency").alias("tuning"), F.col("j.tonal.chords_key").alias("key"), F.col("j.tonal.chords_scale").alias("scale"))


def framewise_labels(files: DataFrame) -> DataFrame:
    """version, frame, label of framewise chords."""
    j = F.from_json("text", "struct<tonal:struct<chords_progression:array<string>>>")["tonal"]["chords_progression"]
    return files.select("version", F.posexplode(j).alias("frame", "label"))


def chord_intervals(files: DataFrame) -> DataFrame:
    j = F.from_json("text", "struct<chordSequence:array<struct<start:double,end:double,label:string>>>")["chordSequence"]
    return files.select("version", F.posexplode(j).alias("i", "c")).select("version", "i", "c.start", "c.end", "c.label")


def indexed_chords(files: DataFrame) -> DataFrame:
    """version, start, index of [[[time, index], ...]]."""
    j = F.from_json("text", "array<array<array<double>>>")[0]
    return files.select("version", F.posexplode(j).alias("i", "c")).select("version", F.col("c")[0].alias("start"), F.col("c")[1].cast("int").alias("index"))


def annotations(files: DataFrame) -> DataFrame:
    """version, i, start, labels of section annotations (time, comma-separated labels);
    apostrophes are left out."""
    lines = files.select("version", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).where("line LIKE '%\t%'")
    labels = F.transform(F.split(F.regexp_replace(F.split("line", "\t")[1], "'", ""), ","), lambda x: F.trim(x))
    return lines.select("version", "i", F.split("line", "\t")[0].cast("double").alias("start"), labels.alias("labels"))


def sections(rows: DataFrame, kind: str) -> DataFrame:
    """version, label, i, length: the first label of a kind in each row, and the rows up
    to the next. Kinds: named (a capital and more than two letters, not Silence), upper
    (up to two capitals), lower (up to two small letters)."""
    pattern = {"named": "^(?!Silence$)[A-Z].{2,}", "upper": "^[A-Z]{1,2}$", "lower": "^[a-z]{1,2}$"}[kind]
    first = F.get(F.filter("labels", lambda x: x.rlike(pattern)), 0)
    w = Window.partitionBy("version").orderBy("i")
    found = rows.withColumn("label", first).where("label IS NOT NULL")
    return found.select("version", "label", "i", F.coalesce(F.lead("i").over(w) - F.col("i"), F.lit(1)).alias("length"))


def lead_sheet(sheet: dict) -> list[str]:
    """The chords of a lead sheet: _form names sections, which hold chords or the names
    of sections (dots ignored), to any depth. A section within itself is an error."""

    def expand(name, above=()):
        if name in above:
            raise ValueError(f"section {name} holds itself")
        body = sheet[name]
        flat = [body] if isinstance(body, str) else [y for x in body for y in ([x] if isinstance(x, str) else x)]
        out = []
        for x in flat:
            for word in x.split():
                key = word.replace(".", "")
                out += expand(key, (*above, name)) if key in sheet and key != "_form" else [word]
        return out

    return [c for part in sheet["_form"] for c in expand(part.replace(".", ""))]


def coded_sequences(files: DataFrame) -> DataFrame:
    """version, time, symbol of {data, labels} files, or vec where there are no labels."""
    j = F.from_json("text", "struct<data:array<array<int>>,labels:array<string>>")
    d = files.select(j.alias("j")).select("j.labels", F.posexplode("j.data").alias("version", "s"))
    return d.select("labels", "version", F.posexplode("s").alias("time", "code")).select("version", "time", F.get("labels", F.col("code")).alias("symbol"))


def fasta_states(spark: SparkSession, path: str) -> DataFrame:
    """version, column, state of an aligned FASTA: a gap has no state."""
    entries = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    e = entries.select(F.regexp_extract("value", r"^version(\d+)", 1).cast("long").alias("version"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "").alias("s"))
    c = e.select("version", F.posexplode(F.split("s", "")).alias("column", "c")).where("c <> ''")
    return c.select("version", "column", F.when(F.col("c") != "-", F.col("column") + 1).alias("state"))


def write_coded(encoded: DataFrame, path: str) -> None:
    """One row {version, codes}; what is there already stays."""
    rows = encoded.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("time", "code"))).alias("s"))
    rows.select("version", F.col("s.code").alias("codes")).write.mode("ignore").json(path)


def write_fasta(encoded: DataFrame, path: str) -> None:
    """Symbols as letters from A on, an entry a version."""
    rows = encoded.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("time", "code"))).alias("s"))
    letters = F.array_join(F.transform("s.code", lambda c: F.char(c + 65)), "")
    rows.select(F.concat(F.lit(">version"), "version", F.lit("\n"), letters).alias("value")).write.mode("ignore").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str):
    from ..operators.graph import Graph

    return Graph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def song_map(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """song, recording, filename of song -> recording -> [{filename}]."""
    j = F.from_json("value", "map<string,map<string,array<struct<filename:string>>>>")
    t = spark.read.text(path, wholetext=True).select(F.explode(j).alias("song", "r"))
    t = t.select("song", F.explode("r").alias("recording", "f")).select("song", "recording", F.explode("f.filename").alias("filename"))
    return t.where(~F.col("song").isin(exclude)) if exclude else t


def tunings(files: DataFrame) -> DataFrame:
    """version, ratio: the number behind 'ratio: '."""
    return files.select("version", F.regexp_extract("text", r"ratio: ([0-9.]+)", 1).cast("double").alias("ratio"))
