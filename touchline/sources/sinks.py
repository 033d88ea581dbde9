"""What the engine writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators.ordered import KEY, entity


def cleaned_documents(cleaned: DataFrame, corrections: DataFrame | None = None, removed: DataFrame | None = None, originals: DataFrame | None = None) -> DataFrame:
    """[K1, F31] One JSON document per match, feed and half: league, season, match_name, half, value; match_id and feed where ``cleaned`` has them.

    A match is its match_id where there is one, else its league, season and
    match_name; the other tables need only those keys, feed and half, and null
    keys are equal.  ``segments`` maps ids to {global_id, start_time, end_time,
    text}; the metadata has counts, corrections, removed rows, all split by
    half only.  A half of which no row is left has no document.
    """
    names = ["league", "season", "match_name"]
    has_id = "match_id" in cleaned.columns
    key = [*(["match_id"] if has_id else names), *[c for c in ("feed",) if c in cleaned.columns], "half"]
    mid = F.col("match_id") if has_id else T.match_key(F.col("league"), F.col("season"), F.col("match_name"))
    payload = F.struct(T.global_id(mid, F.col("half"), F.col("segment_id")).alias("global_id"), "start_time", "end_time", "text")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("segment_id").alias("k"), payload.alias("v")))), lambda x: F.struct(x["k"], x["v"]))
    whole = [F.max(c).alias(c) for c in names if c not in key]
    out = cleaned.groupBy(entity(key)).agg(F.map_from_entries(rows).alias("segments"), F.count("*").alias("n"), *whole)
    if originals is not None:
        out = out.join(originals.groupBy(entity(key)).agg(F.count("*").alias("o")), KEY, "left")
    else:
        out = out.withColumn("o", F.col("n"))

    def listed(df: DataFrame | None, columns: list[str], name: str, out: DataFrame) -> DataFrame:
        if df is None:
            return out.withColumn(name, F.array().cast("array<string>"))
        return out.join(df.groupBy(entity(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), KEY, "left")

    out = listed(corrections, ["segment_id", "original", "corrected", "score", "method", "stage"], "corrections", out)
    out = listed(removed, ["segment_id", "start_time", "text", "reason", "duplicate_of", "similarity"], "removed", out)
    out = out.select(f"{KEY}.*", *[c for c in names if c not in key], "segments", "o", "n", "corrections", "removed")
    meta = F.struct(mid.alias("match_id"), F.col("o").alias("original_segment_count"), F.col("n").alias("cleaned_segment_count"), "corrections", "removed")
    return out.select(*names, *[c for c in key if c not in names], F.to_json(F.struct("segments", meta.alias("cleaning_metadata"))).alias("value"))


def write_documents(documents: DataFrame, root: str) -> None:
    """One text file per partition league/season/match_name/half, as the cleaned layout has it; by feed too where there is one."""
    by = [c for c in ("league", "season", "match_name", "feed", "half") if c in documents.columns]
    documents.select(*by, "value").repartition(*by).write.mode("overwrite").partitionBy(*by).text(root)


def dictionary_document(df: DataFrame, key: str) -> DataFrame:
    """[K2, K3] All rows as one JSON object, keys sorted: a dictionary small enough to be one file."""
    rest = [c for c in df.columns if c != key]
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*rest).alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """[K2] Writes a new version beside the old ones, which readers may still hold; returns its path."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def export_blocks(segments: DataFrame) -> DataFrame:
    """[K4] match_id, feed where there is one, value: 'Part N' blocks of {"segments": {id: [start, end, text]}}, times rounded to 2 places; a missing time or text is null."""
    key = [c for c in ("match_id", "feed") if c in segments.columns]
    at = lambda c: F.coalesce(F.bround(c, 2).cast("string"), F.lit("null"))
    item = F.concat(F.lit("["), at("start_time"), F.lit(", "), at("end_time"), F.lit(", "), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("]"))
    entry = F.concat(F.lit('"'), F.col("segment_id"), F.lit('": '), item)
    halves = segments.groupBy(*key, "half").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]), ", ").alias("b"))
    block = F.concat(F.lit("Part "), F.col("half").cast("string"), F.lit('\n\n{"segments": {'), F.col("b"), F.lit("}}"))
    return halves.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("half", block.alias("v")))), lambda x: x["v"]), "\n\n").alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """[K5] Rows of ``new`` replace those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    """[K6] Spaces around values stay."""
    df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """[K6, K8, K10] A rendered table; refused above ``most`` rows, as it is for readers."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


def evaluation_document(metrics: DataFrame, by: list[str], match: str, variant: str, tolerance: float) -> DataFrame:
    """[K8] One JSON document of an evaluation's rows."""
    rows = F.array_sort(F.collect_list(F.struct(*by, *[c for c in metrics.columns if c not in by])))
    return metrics.agg(F.to_json(F.struct(F.lit(match).alias("match"), F.lit(variant).alias("variant"), F.lit(tolerance).alias("tolerance_s"), rows.alias("rows"))).alias("value"))


def clip(start: Column, end: Column, text: Column, part: Column, minute: Column) -> Column:
    """A search result's clip."""
    return F.struct(start.alias("start"), end.alias("end"), part.alias("part"), T.clip_title(minute, part).alias("title"), text.alias("commentary"))
