"""Document knowledge graph and matching of generated contexts to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import blank, strip
from ragloom.operators.similarity_join import similar_pairs

# Thresholds and fallbacks.
SIMILARITY_THRESHOLD = 0.7
GENERATOR_THRESHOLD = 0.5
DEFAULT_THEME = "Allgemein"
DEFAULT_ENTITY = "Dokument"
EMPTY_TITLE = "Leerer Inhalt"
PREFIXES = [200, 150, 100, 50]
LIST_FIELDS = ["headlines", "keyphrases", "entities", "themes"]

# How many nodes a frequent item may have before its pairs are spread over more tasks.
HOT_ITEM_NODES = 10_000
HOT_ITEM_SALTS = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: F.length(w) > 0)


def _capitalised(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^\p{Lu}"))


def fallback_properties(text: Column) -> dict[str, Column]:
    """Properties taken from the text itself: its capitalised words longer than 4, at most 5, by first occurrence."""
    long_words = F.filter(_words(text), lambda w: (F.length(w) > 4) & _capitalised(w))
    bare = F.transform(long_words, lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))
    entities = F.slice(F.array_distinct(bare), 1, 5)
    none = F.array().cast("array<string>")
    return {
        "title": F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text),
        "headlines": F.array(F.substring(text, 1, 40)),
        "keyphrases": none,
        "entities": F.when(F.size(entities) > 0, entities).otherwise(F.array(F.lit(DEFAULT_ENTITY))),
        "summary": F.substring(text, 1, 200),
        "themes": F.array(F.lit(DEFAULT_THEME)),
    }


def node_properties(outputs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Properties of each chunk from a recorded model output: chunks plus title, lists, summary and embed_text.

    outputs: chunk_id, raw. What precedes the last reasoning tag is dropped, the outermost braces are read; a single
    string becomes a list. Without usable JSON the text's own words stand in. Blank chunks have empty properties.
    """
    answer = F.element_at(F.split("raw", "</think>"), -1)
    start = F.instr(answer, "{")
    stop = F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    found = (start > 0) & (F.instr(answer, "}") > 0) & (stop >= start)
    rows = chunks.join(outputs.select("chunk_id", "raw"), "chunk_id", "left").withColumn(
        "_json", F.when(found, F.substr(answer, start, stop - start + 1))
    )
    rows = rows.withColumn("_json", F.when(F.try_parse_json("_json").isNotNull(), F.col("_json")))
    text, usable = F.col("text"), F.col("_json").isNotNull()
    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        value = F.get_json_object("_json", f"$.{name}")
        as_list = F.from_json(F.when(value.startswith("["), value), "array<string>")
        return F.coalesce(as_list, F.when(F.length(value) > 0, F.array(value)), none)

    def string(name: str, default: Column) -> Column:
        return F.coalesce(F.get_json_object("_json", f"$.{name}"), default)

    for name in LIST_FIELDS:
        rows = rows.withColumn(f"_{name}", listed(name))
    terms = F.filter(F.slice(_words(text), 1, 20), lambda w: (F.length(w) > 5) & _capitalised(w))
    read = {
        "title": string("title", F.substring(text, 1, 50)),
        "headlines": F.when(F.size("_headlines") > 0, F.col("_headlines")).otherwise(F.array(F.substring(text, 1, 30))),
        "keyphrases": F.col("_keyphrases"),
        "entities": F.when(F.size("_entities") > 0, F.col("_entities")).otherwise(F.slice(terms, 1, 3)),
        "summary": string("summary", F.substring(text, 1, 200)),
        "themes": F.when(F.size("_themes") > 0, F.col("_themes"))
        .when(F.size("_keyphrases") > 0, F.slice("_keyphrases", 1, 2))
        .otherwise(F.array(F.lit(DEFAULT_THEME))),
    }
    own = fallback_properties(text)
    empty = {name: none for name in LIST_FIELDS} | {"title": F.lit(EMPTY_TITLE), "summary": F.lit("")}
    for name in read:
        rows = rows.withColumn(
            name, F.when(blank(text), empty[name]).when(usable, read[name]).otherwise(own[name])
        )
    joined = F.concat(text, F.lit("\n\n"), F.col("summary"))
    rows = rows.withColumn("embed_text", F.when(F.length("summary") > 0, joined).otherwise(text))
    return rows.drop("raw", "_json", *[f"_{name}" for name in LIST_FIELDS])


def similarity_edges(vectors: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Edges between nodes (node_id, embedding) whose cosine similarity reaches the threshold."""
    return similar_pairs(vectors, "node_id", threshold).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("cosine_similarity").alias("type"),
        F.col("similarity").alias("weight"), F.array().cast("array<string>").alias("items"),
    )


def overlap_edges(nodes: DataFrame, field: str, min_overlap: int = 1) -> DataFrame:
    """Edges between nodes that share at least `min_overlap` items of `field`, ignoring case and outer blanks.

    Items are ordered from rare to frequent. Two nodes that share m items share one of the first (size - m + 1) of
    each, so only these are joined and the most frequent items rarely are. A pair is kept where it meets on the first
    item it has in common, hence once, and no pairs have to be grouped. Nodes of a frequent item are spread over tasks.
    """
    rows = nodes.select(
        "node_id",
        F.explode(F.array_distinct(F.transform(F.filter(F.col(field), lambda x: F.length(x) > 0),
                                               lambda x: strip(F.lower(x))))).alias("item"),
    )
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    ranked = rows.join(counts, "item").groupBy("node_id").agg(
        F.array_sort(F.collect_list(F.struct("_n", "item"))).alias("_items")
    )
    size = F.size("_items")
    prefix = F.slice("_items", F.lit(1), F.greatest(size - min_overlap + 1, F.lit(0)))
    probes = ranked.filter(size >= min_overlap).select(
        "node_id", F.transform("_items", lambda x: x["item"]).alias("_all"), F.explode(prefix).alias("_p")
    ).select("node_id", "_all", F.col("_p.item").alias("item"), F.col("_p._n").alias("_n"))
    salts = F.when(F.col("_n") > HOT_ITEM_NODES, HOT_ITEM_SALTS).otherwise(1)
    left = probes.withColumn("_salt", F.pmod(F.xxhash64("node_id"), salts)).select(
        "item", F.col("_salt").cast("int").alias("_salt"), F.col("node_id").alias("src"), F.col("_all").alias("_a")
    )
    right = probes.select(
        "item", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), F.col("node_id").alias("dst"),
        F.col("_all").alias("_b"),
    )
    shared = F.array_intersect("_a", "_b")
    return (
        left.join(right, ["item", "_salt"])
        .filter(F.col("src") < F.col("dst"))
        .withColumn("_shared", shared)
        .filter((F.size("_shared") >= min_overlap) & (F.col("_shared")[0] == F.col("item")))
        .select(
            "src", "dst", F.lit(f"{field}_overlap").alias("type"), F.size("_shared").cast("double").alias("weight"),
            F.array_sort("_shared").alias("items"),
        )
    )


def knowledge_graph(
    nodes: DataFrame, threshold: float = SIMILARITY_THRESHOLD, min_overlap: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(edges of all three kinds, their counts per type). nodes: node_id, embedding, entities, keyphrases."""
    edges = (
        similarity_edges(nodes.select("node_id", "embedding"), threshold)
        .unionByName(overlap_edges(nodes, "entities", min_overlap))
        .unionByName(overlap_edges(nodes, "keyphrases", min_overlap))
    )
    return edges, edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def match_contexts(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk of each context: (context_id, chunk_id). contexts: context_id, text; chunks: chunk_id, text.

    Tried in turn: the whole text, its first 200, 150, 100, 50 characters, and the first stored text over 100
    characters whose first 80 occur in the context's first 200. Stored texts are whole chunks and their prefixes; of
    several chunks with one such text the last by id counts. What matches nothing gets a hash id. Texts meet by their
    digest, so copies fold into one row before the join.
    """
    whole = strip(F.col("text"))
    stored_texts = F.array(*[strip(F.substring("text", 1, n)) for n in reversed(PREFIXES)], whole)
    keys = (
        chunks.select("chunk_id", F.posexplode(stored_texts).alias("_slot", "_key"))
        .filter(F.length("_key") > 0)
        .groupBy(F.sha2("_key", 256).alias("_digest"))
        .agg(
            F.max("chunk_id").alias("chunk_id"),
            F.min(F.struct("chunk_id", "_slot")).alias("_first"),
            F.first(F.when(F.length("_key") > 100, F.substring("_key", 1, 80))).alias("_head"),
        )
    )
    asked = contexts.filter(~blank(F.col("text"))).select("context_id", "text", whole.alias("_clean"))
    tries = F.array(F.col("_clean"), *[strip(F.substring("_clean", 1, n)) for n in PREFIXES])
    direct = (
        asked.select("context_id", F.posexplode(tries).alias("_try", "_text"))
        .select("context_id", "_try", F.sha2("_text", 256).alias("_digest"))
        .join(keys.select("_digest", "chunk_id"), "_digest")
        .groupBy("context_id")
        .agg(F.min_by("chunk_id", "_try").alias("_direct"))
    )
    begin = F.substring("_clean", 1, 200)
    starts = F.sequence(F.lit(1), F.length(begin) - 79)
    windows = F.when(F.length(begin) >= 80, F.transform(starts, lambda i: F.substr(begin, i, F.lit(80))))
    heads = (
        keys.filter(F.col("_head").isNotNull())
        .groupBy("_head")
        .agg(F.min(F.struct("_first", "chunk_id")).alias("_best"))
    )
    inside = (
        asked.join(direct, "context_id", "left_anti")
        .select("context_id", F.explode(F.array_distinct(windows)).alias("_head"))
        .join(heads, "_head")
        .groupBy("context_id")
        .agg(F.min("_best").alias("_best"))
        .select("context_id", F.col("_best.chunk_id").alias("_inside"))
    )
    fallback = F.concat(F.lit("synth_chunk_"), F.substring(F.md5(F.substring("text", 1, 50)), 1, 8))
    return (
        asked.join(direct, "context_id", "left")
        .join(inside, "context_id", "left")
        .select("context_id", F.coalesce("_direct", "_inside", fallback).alias("chunk_id"))
    )
