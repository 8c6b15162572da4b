"""The index on disk: generations of tables, segments of new articles, and one manifest that is swapped in a single step.

A manifest names the folders of one generation, so who reads an index sees all of the old one or all of the new one, never a mixture. Folders are never written
twice; `tidy` deletes those that no manifest names any more.

Articles are appended as segments: only the new texts are tokenised, and their counts and headers written. Every weight depends on the number of all articles,
so weights are derived anew when segments are merged: document frequencies of the segments are added to the old ones by term, and all counts weighed;
no text is read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans.index import TOKENIZERS, Index, directory, headers, idf_of, term_counts, weighed_rounds
from inkstone.plans.kept import append_rounds, delete, freed

MANIFEST = "manifest.json"
#: Tables that grow by segments, and those derived from all of them together.
SEGMENTED, DERIVED = ("articles", "counts", "heads", "title_terms"), ("idf", "postings", "parts")


def _paths(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, at.getFileSystem(conf), conf


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the store holds, or None before the first save."""
    fs_, fs, _ = _paths(spark, path)
    at = fs_.Path(f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, said: dict) -> None:
    """Writes the manifest beside the old one and renames it over that, which file systems do in one step."""
    fs_, fs, conf = _paths(spark, path)
    new = fs_.Path(f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(new)
    stream.write(bytearray(json.dumps(said, indent=1).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(fs_.Options.Rename, 1)
    options[0] = fs_.Options.Rename.OVERWRITE
    fs_.FileContext.getFileContext(fs.makeQualified(new).toUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(fs_.Path(f"{path}/{MANIFEST}")), options)


def _write(df: DataFrame, path: str, name: str) -> str:
    """A table in a folder of its own; postings sorted by term, so that a few terms touch few row groups. Gives the folder's name within the store."""
    folder = f"{name}-{uuid.uuid4().hex}"
    if name == "postings":
        df = df.repartitionByRange("term", "kind", "slice").sortWithinPartitions("term", "kind", "slice")
    df.write.option("compression", "zstd").parquet(f"{path}/{folder}")
    return folder


def _write_rounds(rounds: Iterable[DataFrame], path: str) -> str:
    """Postings in rounds, each sorted by term, in a folder of their own."""
    folder = f"postings-{uuid.uuid4().hex}"
    append_rounds((df.repartitionByRange("term", "kind", "slice").sortWithinPartitions("term", "kind", "slice") for df in rounds), f"{path}/{folder}", compression="zstd")
    return folder


def save(index: Index, path: str) -> None:
    """The whole index as a new generation."""
    spark = index.articles.sparkSession
    tables = {name: [_write(df, path, name)] for name, df in index.tables().items()}
    _swap(spark, path, {"tokenizer": index.tokenizer, "backend": index.backend, "tables": tables, "pending": []})


def load(spark: SparkSession, path: str) -> Index:
    """The newest generation; segments that are not merged yet take no part."""
    said = manifest(spark, path)
    if said is None or not said["tables"]:
        raise FileNotFoundError(f"no index at {path}" + " yet: its segments are not merged" * (said is not None))
    read = lambda name: spark.read.parquet(*[f"{path}/{x}" for x in said["tables"][name]]) if name in said["tables"] else None
    return Index(read("articles"), read("idf"), read("postings"), read("title_terms"), said["tokenizer"], said["backend"], read("parts"), read("heads"))


def append(articles: DataFrame, path: str, tokenizer: str = "korean-char-bigram-v1") -> int:
    """New articles as a segment of the store at path, which may be empty as yet; ids that it holds already, merged or pending, are left out. Gives the number of new ones.

    They are found only after the next merge.
    """
    spark = articles.sparkSession
    said = manifest(spark, path) or {"tokenizer": tokenizer, "backend": "tfidf", "tables": {}, "pending": []}
    if said["backend"] != "tfidf":
        raise ValueError("only a sparse index grows by segments")
    repeated = articles.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    new = articles if repeated.isEmpty() else articles.dropDuplicates(["id"])  # texts are sorted for repeated ids only
    stored = [f"{path}/{x}" for part in [said["tables"], *said["pending"]] for x in part.get("heads", [])]
    if stored:
        new = new.join(spark.read.parquet(*stored).select("id"), "id", "left_anti")
    segment = {"articles": [_write(new.select(articles.columns), path, "articles")]}
    freed(spark)
    new = spark.read.schema(new.select(articles.columns).schema).parquet(f"{path}/{segment['articles'][0]}")
    n = new.count()
    if n:
        titles = new.select("id", F.explode(F.array_distinct(TOKENIZERS[said["tokenizer"]](F.col("title")))).alias("term"))
        tables = {"counts": term_counts(new, said["tokenizer"]), "heads": headers(new, said["tokenizer"]), "title_terms": titles}
        said["pending"].append(segment | {name: [_write(df, path, name)] for name, df in tables.items()})
        _swap(spark, path, said)
        del tables, titles
    else:
        delete(spark, f"{path}/{segment['articles'][0]}")
    del new
    freed(spark)
    return n


def merge(spark: SparkSession, path: str, alone: bool = False) -> Index:
    """Pending segments become part of the index, which then equals one built from all articles at once.

    alone: nobody reads the index meanwhile, so the old postings are deleted before the new ones are written. Until then all segments count as pending.
    """
    said = manifest(spark, path)
    if said is None:
        raise FileNotFoundError(f"no index at {path}")
    if not said["pending"]:
        return load(spark, path)
    read = lambda names: spark.read.parquet(*[f"{path}/{x}" for x in names])
    old, pending = said["tables"], said["pending"]
    if alone and "counts" in old:
        _swap(spark, path, said | {"tables": {}, "pending": [{name: old[name] for name in SEGMENTED}, *pending]})
        for folder in (*old["postings"], *old["parts"]):
            delete(spark, f"{path}/{folder}")
    tables = {name: [*old.get(name, []), *[x for part in pending for x in part[name]]] for name in SEGMENTED}
    if old and "counts" not in old:  # saved whole: its counts are written down at the first merge
        tables["counts"].append(_write(term_counts(read(old["articles"]), said["tokenizer"]), path, "counts"))
    counts = read(tables["counts"])
    fresh = [x for part in pending for x in part["counts"]]
    df = read(fresh).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if "idf" in old:
        df = df.unionByName(read(old["idf"]).select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    n = read(tables["heads"]).count()
    tables["idf"] = [_write(df.select("term", "df", idf_of(F.lit(n), F.col("df")).alias("idf")), path, "idf")]
    idf = read(tables["idf"])
    del df
    freed(spark)
    tables["postings"] = [_write_rounds(weighed_rounds(counts, idf), path)]
    tables["parts"] = [_write(directory(read(tables["postings"]), idf), path, "parts")]
    freed(spark)
    _swap(spark, path, said | {"tables": tables, "pending": []})
    return load(spark, path)


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Deletes folders that the manifest doesn't name; not while someone still reads an older generation. Gives their names."""
    said = manifest(spark, path)
    fs_, fs, _ = _paths(spark, path)
    used = {x for part in [said["tables"], *said["pending"]] for names in part.values() for x in names} if said else set()
    gone = [s.getPath() for s in fs.listStatus(fs_.Path(path)) if s.isDirectory() and s.getPath().getName() not in used]
    for at in gone:
        fs.delete(at, True)
    return sorted(at.getName() for at in gone)
