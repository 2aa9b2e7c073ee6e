"""Benchmark decontamination over a positional inverted index of the training documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.skew import blocks, sized, split_by_hash, unused
from quillwork.storage import written, written_in_parts
from quillwork.tables import spread

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # lower() and translate() make letters of letters only
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What lower() may change but A-Z: capitals and title case; the ranges where versions of Unicode add capitals, too.
_OTHER_CAPITAL = r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{Lt}\x{1C80}-\x{1CBF}\x{2C00}-\x{2C5F}\x{A640}-\x{A7FF}\x{10000}-\x{10FFFF}]]"
#: A page holds the dictionary of a million hashes, so a word costs some two bytes.
DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}
#: Rows of a broadcast block. Rows have a fixed width, of 150 bytes at most, so a block has under 40 MB.
BLOCK_ROWS = 250_000


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case: runs of ASCII letters and digits, and of all that is not ASCII.

    lower() is many times faster than translate() and gives the same where the text has no other capitals. Null has
    no words.
    """
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.rlike(text, F.lit(_OTHER_CAPITAL)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def terms(text: Column) -> Column:
    """The words of a text, as hashes."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def phrases(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(phrase, size, terms) of the distinct windows of the items, and (phrase, item) of their items, written.

    An item of fewer words than a window, but not none, is one. A phrase is the hash of its terms.
    """
    listed = items.select(F.col(id_col).alias("item"), terms(F.col(text_col)).alias("t")).filter("size(t) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - (window - 1), F.lit(1)))
    cut = listed.select("item", F.explode(F.transform(starts, lambda s: F.slice("t", s, F.lit(window)))).alias("terms"))
    cut = written(cut.select(F.xxhash64("terms").alias("phrase"), "terms", "item").distinct(), "windows")
    return cut.groupBy("phrase").agg(F.first("terms").alias("terms")).withColumn("size", F.size("terms")), cut.select("phrase", "item").filter("item is not null")


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, of (hash of the text, so that texts with one id stay apart), n_words and t: the terms by position; written.

    The one pass over the texts; all that follows reads hashes.
    """
    read = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    cut = read.select("id", F.xxhash64("text").alias("of"), terms(F.col("text")).alias("t"))
    return written(cut.select("id", "of", F.size("t").cast("long").alias("n_words"), "t"), "tokens", **DICTIONARY)


def term_counts(tokens: DataFrame, vocabulary: DataFrame, block_rows: int) -> DataFrame:
    """How often each term of the ``vocabulary`` stands in the documents.

    If it fits one block, other words go first; else all words are counted, map side first, and the counts meet the
    terms: in neither case does a frequent term's every word cross the network.
    """
    every = tokens.select(F.explode("t").alias("term"))
    few = vocabulary.limit(block_rows + 1).count() <= block_rows
    counted = (every.join(F.broadcast(vocabulary), "term", "left_semi") if few else every).groupBy("term").agg(F.count("*").alias("n"))
    return counted if few else counted.join(vocabulary, "term", "left_semi")


def rarest(queries: DataFrame, counts: DataFrame, lists: int) -> DataFrame:
    """phrase, size and ``rare``: (n, offset, term) of its ``lists`` rarest terms, the rarest first.

    A phrase with a term that no document has goes: it can't occur.
    """
    each = queries.select("phrase", "size", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    found = each.groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("found"), F.count_if(F.col("n").isNull()).alias("missing"))
    return found.filter("missing = 0").select("phrase", "size", F.slice("found", 1, lists).alias("rare"))


def postings(tokens: DataFrame, chosen: DataFrame, lists: int, block_rows: int) -> DataFrame:
    """The index: term, id, of, pos of the chosen terms' every place; written.

    A term that leads phrases (is their rarest) has a posting for each offset and size that it has in one, with
    ``window``: the hash of the terms that stand there, so that a place can be compared in full without its text. There
    are at most as many as sizes and offsets under the window's, whatever the number of phrases. Terms are broadcast
    block by block, each a pass over the tokens, so that no word crosses the network to learn that it isn't wanted.
    """
    lead = F.col("rare")[0]
    leads = chosen.select(lead["term"].alias("term"), lead["offset"].alias("offset"), "size").distinct()
    follow = chosen.select(F.explode(F.slice("rare", 2, 1 << 20)).alias("r")).select(F.col("r.term").alias("term"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("size")).distinct()
    wanted = written(sized(leads.unionByName(follow), chosen.count() * lists), "index-terms")
    every = tokens.select("id", "of", "n_words", "t", F.posexplode("t").alias("pos", "term"))
    start = F.col("pos") - F.col("offset")
    inside = F.col("offset").isNull() | ((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    around = F.when(F.col("offset").isNotNull(), F.xxhash64(F.slice("t", start + 1, F.col("size"))))
    return written_in_parts([every.join(b, "term").filter(inside).select("term", "id", "of", "pos", "offset", "size", around.alias("window")) for b in blocks(wanted, "term", block_rows)], "postings")


def intersect(index: DataFrame, chosen: DataFrame, lists: int, block_rows: int) -> DataFrame:
    """id, of, start, phrase, size of the places that the offset-adjusted lists of the rarest terms share; written.

    The list of the rarest term is read first, and its places are compared in full by their windows' hashes; each next
    list only confirms or drops what is left. Phrases meet the first list as broadcast blocks; the next lists' keys are
    (document, place), which no frequent term fills, and only postings of documents with a place left are moved.
    """
    first, key = F.col("rare")[0], ["term", "offset", "size", "window"]
    leading = index.filter(F.col("offset").isNotNull())
    queries = chosen.select("phrase", "size", "rare", first["term"].alias("term"), first["offset"].alias("offset"), F.col("phrase").alias("window"))
    place = ["id", "of", (F.col("pos") - F.col("offset")).alias("start"), "phrase", "size", "rare"]
    rows = index.count()  # a posting has one phrase at most
    at = written_in_parts([sized(leading.join(b, key).select(*place).distinct(), rows) for b in blocks(queries, "phrase", block_rows)], "first-list")  # a phrase is in one block
    following = index.filter(F.col("offset").isNull()).select(F.col("id").alias("i"), F.col("of").alias("o"), F.col("pos").alias("p"), F.col("term").alias("t"))
    near, _ = split_by_hash(following, F.xxhash64("i", "o"), at.select("id", "of").distinct(), F.xxhash64("id", "of"))
    for k in range(1, lists):
        other = F.get("rare", F.lit(k))
        held = at.filter(other.isNotNull()).join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("of") == F.col("o")) & (F.col("start") + other["offset"] == F.col("p")) & (other["term"] == F.col("t")), "left_semi")
        at = held.unionByName(at.filter(other.isNull()))
    return written(sized(at.drop("rare"), rows), "places")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    A word is hit that lies in an occurrence of a window of an item; contaminated: any is hit, and at least 1 in
    ``share`` (20). The places that the index finds are compared in full, as hashes of their words. Ids of documents
    and items have any type that strings can be made of. Null and empty texts have no words; very long ones are read
    whole; repeated rows get the same answer, and null ids are a document for each text; null item ids have no name
    and don't count as items. Of equally rare terms of a phrase the first leads. No items, or none that occurs: nothing
    is hit, and items_sha256 is that of the empty string; no documents: no rows. Other columns are not read.
    """
    return judge(docs, items, id_col=id_col, text_col=text_col, **options).drop("of").withColumnRenamed("id", id_col)


def judge(docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", share: int = 20, window: int = 13, lists: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``decontaminate`` by id and of, the hash of the text. No text is moved: what is shuffled are places and ids."""
    tokens = token_table(docs, id_col, text_col)
    queries, named = phrases(items, window, item_col, item_text_col)
    n = queries.count()
    counts = term_counts(tokens, queries.select(F.explode("terms").alias("term")).distinct(), block_rows)
    counts = written(sized(counts, n * window), "term-counts")
    chosen = written(sized(rarest(queries, counts, lists), n), "rarest")
    places = intersect(postings(tokens, chosen, lists, block_rows), chosen, lists, block_rows)

    spans = F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    union = F.aggregate("spans", zero, lambda s, p: F.struct((s["sum"] + F.greatest(p["b"] - F.greatest(p["a"], s["end"]), F.lit(0))).alias("sum"), F.greatest(s["end"], p["b"]).alias("end")))
    hit = places.groupBy("id", "of").agg(spans.alias("spans")).select("id", "of", union["sum"].cast("long").alias("n_hit"))
    found = places.select("id", "of", "phrase").distinct()
    told = written_in_parts([found.join(b, "phrase").select("id", "of", F.col("item").cast("string").alias("item")) for b in blocks(named, "phrase", block_rows)], "items").distinct()
    told = told.groupBy(F.col("id").alias("i"), F.col("of").alias("o")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = hit.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("of") == F.col("o")), "left").select(F.col("id").alias("i"), F.col("of").alias("o"), "n_hit", "items")
    out = tokens.select("id", "of", "n_words").join(written(both, "hits"), F.col("id").eqNullSafe(F.col("i")) & (F.col("of") == F.col("o")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("id", "of", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` doesn't call contaminated; all columns stay, whatever their names.

    Rows that can't be contaminated, by a bit of their hash, stay where they are; only the others meet the list.
    """
    judged = judge(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = written(judged.filter("contaminated").select("id", "of").distinct(), "contaminated")
    i, o = unused(docs.columns, "__id"), unused(docs.columns, "__of")
    named = bad.select(F.col("id").alias(i), F.col("of").alias(o))
    maybe, clean = split_by_hash(docs, F.xxhash64(F.col(id_col), F.xxhash64(text_col)), named, F.xxhash64(i, o))
    return clean.unionByName(maybe.join(named, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(o)), "left_anti"))


def proximity_matches(docs: DataFrame, items: DataFrame, *, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", lists: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, item, start: where the ``lists`` rarest words of an item (all, if it has fewer) stand in any order within
    ``slop`` words of the rarest one, at ``start``. Words that no document has are left out; none left: no match. Of
    equally rare words, the one that sorts first.

    Lists meet by document, term and cell of slop + 1 words, so a place is compared with those near it only. Rows
    without id are a document for each text, repeated rows are one.
    """
    tokens = token_table(docs, id_col, text_col)
    named = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(words(F.col(item_text_col)))).alias("word")).distinct()
    wanted = written(named.withColumn("term", F.xxhash64("word")), "item-terms")
    counts = term_counts(tokens, wanted.select("term").distinct(), block_rows)
    ranked = wanted.join(counts, "term").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word", "term"))), 1, lists).alias("rare"))
    ranked = written(ranked.select("item", F.transform("rare", lambda r: r["term"]).alias("rare")), "rarest-terms")
    every = tokens.select("id", "of", F.posexplode("t").alias("pos", "term"))
    listed = written(ranked.select(F.explode("rare").alias("term")).distinct(), "index-terms")
    index = written_in_parts([every.join(b, "term", "left_semi") for b in blocks(listed, "term", block_rows)], "postings")
    leads = ranked.withColumn("term", F.col("rare")[0])
    at = written_in_parts([index.join(b, "term").select("id", "of", "item", F.col("pos").alias("start"), "rare") for b in blocks(leads, "term", block_rows)], "first-list").distinct()
    near = at.select("*", F.posexplode("rare").alias("k", "term"))
    near = near.select("*", F.explode(F.sequence(F.floor((F.col("start") - slop) / (slop + 1)), F.floor((F.col("start") + slop) / (slop + 1)))).alias("cell"))
    cells = index.withColumn("cell", F.floor(F.col("pos") / (slop + 1)))
    met = near.alias("x").join(cells.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")) & F.expr("x.of = y.of and x.term = y.term and x.cell = y.cell")).filter(F.abs(F.col("y.pos") - F.col("x.start")) <= slop)
    held = met.groupBy(F.col("x.id").alias("id"), F.col("x.of").alias("of"), "item", "start", F.size("rare").alias("n")).agg(F.count_distinct("k").alias("found"))
    return held.filter("found = n").select(F.col("id").alias(id_col), "item", "start").distinct()
