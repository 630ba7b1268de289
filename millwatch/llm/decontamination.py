"""Benchmark decontamination with a positional inverted index, in native operations only.

The index holds the postings (term, document, position) of every training token that
some test item uses, written once to the shared folder.  A phrase (a window of a test
item) is looked up from its rarest terms: their lists, each shifted by the term's
offset in the phrase, are intersected, which leaves almost only true occurrences; those
are then compared with the text word by word.  ``proximity_matches`` asks instead that
the rarest terms of a phrase stand near each other in any order.

Results for odd rows: a NULL or empty document has no words and no hits; an item
without words (NULL, empty) occurs nowhere; items without an id count for hit words but
are not listed; items with equal ids are one item; documents are told apart by id and
text, so repeated rows all come back with equal results; empty tables give no hits, or
no rows.  Texts of any length are read whole; equally rare terms follow their place in
the phrase.  Other columns pass unchanged; one that has the name of a result comes back as
``<name>_of_table``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.text import plain_words, put_back, set_apart
from millwatch.session import stored

WINDOW = 10
#: How many of a phrase's rarest terms are intersected before the comparison with the text.
RAREST = 3
#: A test vocabulary up to this size is sent to all tasks; a larger one is joined by shuffling.
BROADCAST_TERMS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def test_phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, item): every window of every item; a shorter item is one phrase; words joined by a space."""
    words = items.select(F.col(item_id).cast("string").alias("item"), plain_words(F.col(text)).alias("words"))
    words = words.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(
        F.slice("words", i, window), " "))).alias("phrase")).distinct()


def document_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored postings (term, doc, text_hash, pos) of the terms in ``vocabulary`` (term)."""
    tokens = docs.select(F.col(id_col).alias("doc"), document_key(text).alias("text_hash"),
                         F.posexplode(plain_words(F.col(text))).alias("pos", "term"))
    small = vocabulary.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    known = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "term", "left_semi")
    return stored(known.select("term", "doc", "text_hash", "pos"), "postings")


def rarest_terms(phrases: DataFrame, postings: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(phrase, anchors): the rarest terms of each phrase with their offsets; phrases with an unseen term go."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    seen = terms.join(counts, "term", "left").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("all"))
    return seen.filter(F.col("all")[0]["n"] > 0).select("phrase", F.slice("all", 1, rarest).alias("anchors"))


def _anchor(i: int, field: str) -> Column:
    return F.get("anchors", F.lit(i))[field]


def candidates(postings: DataFrame, anchors: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(phrase, doc, text_hash, start) where the shifted lists of the rarest terms meet."""
    first = anchors.select("phrase", "anchors", _anchor(0, "term").alias("term"), _anchor(0, "offset").alias("offset"))
    # Few postings belong to rarest terms; the others need not be moved.
    rare = postings.join(first.select("term").distinct(), "term", "left_semi")
    found = rare.join(first, "term").select(
        "phrase", "doc", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "anchors").filter("start >= 0")
    for i in range(1, rarest):
        terms = anchors.select(_anchor(i, "term").alias("term")).filter("term is not null").distinct()
        other = postings.join(terms, "term", "left_semi").select(
            F.col("term").alias("_term"), F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("pos").alias("_pos"))
        longer, done = found.filter(F.size("anchors") > i), found.filter(F.size("anchors") <= i)
        meet = longer.join(
            other, (_anchor(i, "term") == F.col("_term")) & F.col("doc").eqNullSafe(F.col("_doc"))
            & (F.col("text_hash") == F.col("_hash")) & (F.col("start") + _anchor(i, "offset") == F.col("_pos")), "left_semi")
        found = meet.unionByName(done)
    return found.drop("anchors")


def proximity_matches(postings: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """(phrase, doc, text_hash, pos): all anchors of the phrase stand within ``width`` words of its rarest one at ``pos``.

    The distance is searched by stretches of ``width`` words: a term within reach lies
    in the same stretch or in one next to it.
    """
    rare = anchors.select("phrase", "anchors", _anchor(0, "term").alias("term"))
    at = postings.join(rare, "term").select("phrase", "doc", "text_hash", "pos", "anchors").distinct()
    need = at.select("phrase", "doc", "text_hash", "pos", F.explode(F.array_distinct(F.transform(
        "anchors", lambda a: a["term"]))).alias("_need"))
    need = need.withColumn("_stretch", F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])))
    wanted = anchors.select(F.explode(F.transform("anchors", lambda a: a["term"])).alias("term")).distinct()
    other = postings.join(wanted, "term", "left_semi").select(
        F.col("term").alias("_need"), F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("pos").alias("_pos"),
        F.floor(F.col("pos") / width).alias("_at"))
    near = need.join(other, (need["_need"] == other["_need"]) & need["doc"].eqNullSafe(other["_doc"])
                     & (need["text_hash"] == other["_hash"]) & (need["_stretch"] == other["_at"])
                     & (F.abs(need["pos"] - other["_pos"]) <= width)).select(
        "phrase", "doc", "text_hash", "pos", need["_need"].alias("_found")).distinct()
    sizes = anchors.select("phrase", F.size(F.array_distinct(F.transform("anchors", lambda a: a["term"]))).alias("_size"))
    return near.groupBy("phrase", "doc", "text_hash", "pos").count().join(sizes, "phrase").filter(
        F.col("count") == F.col("_size")).select("phrase", "doc", "text_hash", "pos")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items (sorted ids as text) and contaminated added."""
    phrases = stored(test_phrases(items, item_id, item_text, window), "phrases")
    vocabulary = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    postings = build_index(docs, vocabulary, id_col, text)
    anchors = stored(rarest_terms(phrases, postings), "anchors")
    # A document's own candidates: no more than its windows.
    listed = phrases.groupBy("phrase").agg(F.collect_set("item").alias("of"))
    grouped = candidates(postings, anchors).join(listed, "phrase").groupBy(
        F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set(F.struct("start", "phrase", "of")).alias("_found"))
    out = set_apart(docs, id_col, text).withColumn("_key", document_key(text)).join(
        grouped, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_hash")), "left")
    out = out.withColumn("_words", F.when(F.col("_found").isNotNull(), plain_words(F.col(text))))
    length = lambda c: F.size(F.split(c["phrase"], " "))
    # Named twice, the words are worked out once, in a step of their own, not for every candidate.
    out = out.withColumn("_true", F.when(F.size("_words") > 0, F.filter("_found", lambda c: F.array_join(
        F.slice("_words", c["start"] + 1, length(c)), " ") == c["phrase"])))
    hit = F.size(F.array_distinct(F.flatten(F.transform("_true", lambda c: F.sequence(
        c["start"], c["start"] + length(c) - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_true", lambda c: c["of"]))))
    out = out.withColumns({
        "n_words": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)).cast("long"),
        "n_hit": F.when(F.size("_true") > 0, hit).otherwise(0).cast("long"),
        "items": F.coalesce(items, F.array().cast("array<string>")),
    }).withColumns({
        "n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0,
    })
    return put_back(out, docs.columns, [id_col, text], ["n_words", "n_hit", "items", "n_items", "contaminated"])
