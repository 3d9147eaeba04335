"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every document.

Native: DataFrame functions only. Every document word window is hashed; the hash probes the benchmark's
windows (broadcast when their counted number and bytes are bounded, shuffled otherwise), and each hit is verified word
by word in the join condition, so equal hashes alone never count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import BROADCAST_ROWS, join_checked, written

#: A word: runs of ASCII letters and digits and of everything from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A break, with the capitals that WORD would break at; used on text as it is.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 8
#: Distinct benchmark windows, and bytes of their words and item ids, up to which they are broadcast.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text):
    """Lower-cased (A-Z only) words of a text column; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _window_hashes(hashes, n: int):
    """hash of each n-word window by its start, from the words' hashes."""
    many = F.size(hashes) - (n - 1)
    starts = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))


def _placed(hashes, n: int):
    return F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), F.lit(n).alias("n"), h.alias("h")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_hash, window_words, items): distinct windows with the item ids (as strings) that hold them.

    An item of fewer words than the window, but not none, is one window. Items without words have none.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.lit(window), F.size("ws"))
    w = w.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.slice("ws", i + 1, n))).alias("window_words"))
    w = w.groupBy("window_words").agg(F.collect_set("item").alias("items"))
    # the same nesting as _window_hashes: a hash of the words' hashes
    by_size = F.xxhash64(F.lit(None))
    for k in range(1, window + 1):
        by_size = F.when(F.size("window_words") == k, F.xxhash64(*[F.xxhash64(F.get("window_words", F.lit(j))) for j in range(k)])).otherwise(by_size)
    return w.select(by_size.alias("window_hash"), "window_words", "items")


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """One row for each row of documents: keep columns, _n_words, _hits (array of struct(pos, n, items)).

    Hits are verified windows: pos (0-based word), n words, the item ids. Null or empty text: no words, no hits.
    Repeated rows each get their own row; extra columns are ignored unless kept. An empty benchmark gives no hits.
    """
    bench = written(benchmark_windows(benchmark, window), "benchmark-windows")
    n_windows, n_bytes = bench.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "window_words")) * 4 + F.length(F.concat_ws(" ", "items")))).first()
    sizes = [r[0] for r in bench.select(F.size("window_words").alias("n")).distinct().collect()]  # at most `window` values
    docs = documents.select(F.monotonically_increasing_id().alias("_row"), *keep, words(F.col(text)).alias("_words"))
    docs = docs.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    spans = [_placed(_window_hashes(F.col("_hashes"), n), n) for n in sorted(sizes)]
    # a row of its own for each document, with a key of its own: in a shuffled join they don't meet in one task
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.xxhash64("_row").alias("h")))
    # the windows are a column before they are exploded: the explode is then compiled with the join, and a window's row
    # points into its document's words instead of copying them. Never empty; the outer form spares an inferred filter on
    # its size, which would compute all hashes anew for each window
    docs = docs.withColumn("_spans", F.concat(mark, *spans))
    rows = docs.select("_row", *keep, "_words", F.size("_words").cast("long").alias("_n_words"), F.explode_outer("_spans").alias("_w"))
    rows = rows.select("_row", *keep, "_words", "_n_words", F.col("_w.pos").alias("_pos"), F.col("_w.n").alias("_n"), F.col("_w.h").alias("_h"))
    bench = bench.select(F.col("window_hash").alias("_bh"), F.col("window_words").alias("_bw"), F.col("items").alias("_items"))
    own = F.slice("_words", F.greatest(F.col("_pos"), F.lit(0)) + 1, F.greatest(F.col("_n"), F.lit(1)))
    if n_windows <= BROADCAST_WINDOWS and (n_bytes or 0) <= BROADCAST_BYTES:
        bench = F.broadcast(bench)
    else:
        # a window is moved with its own words, not with all of its document's
        rows, own = rows.withColumn("_own", own).drop("_words"), F.col("_own")
    # only for equal hashes are the words themselves compared: two inequalities, as an equality would be a join key
    # that is built for every window
    hits = rows.join(bench, (F.col("_h") == F.col("_bh")) & (F.col("_pos") >= 0) & (own <= F.col("_bw")) & (own >= F.col("_bw")), "left").where("_pos < 0 or _items is not null")
    hit = F.when(F.col("_pos") >= 0, F.struct(F.col("_pos").alias("pos"), F.col("_n").alias("n"), F.col("_items").alias("items")))
    return hits.groupBy("_row", *keep, "_n_words").agg(F.collect_list(hit).alias("_hits"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents."""
    s = scan(documents, benchmark, window)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1))))
    s = s.select("doc_id", F.col("_n_words").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), items.alias("_items"))
    return s.select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.size("_items") >= least_items).alias("contaminated"))


def _runs(hit):
    """struct(a, z) of each run of adjacent positions in a sorted array of distinct ones; z is exclusive."""
    starts = F.filter(hit, lambda x, i: (i == 0) | (F.get(hit, i - 1) != x - 1))
    ends = F.filter(hit, lambda x, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("a"), (z + 1).alias("z")))


def _without(words_, breaks, runs):
    """The text without runs of words. It is break, word, break ... word, break; what stands between two words of a
    run goes with them, the break before a run becomes a space, and the one after it stays."""
    n = F.size(words_)
    edges = F.concat(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("z"))), runs, F.array(F.struct(n.alias("a"), n.alias("z"))))

    def kept(i):
        begin, end = F.get(edges, i)["z"], F.get(edges, i + 1)["a"]
        tail = F.when(end < n, F.lit(" ")).otherwise(F.get(breaks, n))
        after = F.concat(F.slice(breaks, begin + 2, end - begin - 1), F.array(tail))
        some = F.array_join(F.zip_with(F.slice(words_, begin + 1, end - begin), after, lambda w, b: F.concat(w, b)), "")
        return F.concat(F.get(breaks, begin), F.when(end > begin, some).otherwise(F.lit("")))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), kept), "")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 2, most_hit: float = 0.5) -> DataFrame:
    """documents without rows that hold least_items benchmark items or are hit in over most_hit of their words;
    in the others hit words, with what stands between two hit words, are cut out. Rows without hits stay as they are;
    columns other than text and n_chars are carried as they come, whatever their names.
    """
    cols = documents.columns
    # a row is known by a digest of doc_id and text: rows that share it have equal hits
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-"))), 256)
    keyed = documents.select(F.struct("*").alias("doc"), key.alias("key"))
    s = scan(keyed.select("key", F.col("doc.text").alias("text")), benchmark, window, keep=("key",)).where(F.size("_hits") > 0).dropDuplicates(["key"])
    n_items = F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1)))))
    s = s.select("key", covered.alias("hit"), n_items.alias("n_items"), "_n_words")
    s = s.select("key", F.when((F.col("n_items") < least_items) & (F.size("hit") <= F.lit(most_hit) * F.col("_n_words")), _runs(F.col("hit"))).alias("runs"), F.lit(True).alias("found"))
    s = written(s, "benchmark-hits")
    small = (s.agg(F.sum(F.size("runs"))).first()[0] or 0) <= 50 * BROADCAST_ROWS
    s = join_checked(keyed, s, "key") if small else keyed.join(s, "key", "left")
    s = s.where("found is null or runs is not null")
    original = F.col("doc.text")
    some = F.col("found").isNotNull()
    texts = F.regexp_extract_all(original, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    breaks = F.split(F.translate(original, UPPER, LOWER), WORD, -1)
    s = s.select("doc", "runs", "found", F.when(some, texts).alias("words"), F.when(some, breaks).alias("breaks"))
    text = F.when(some, _without(F.col("words"), F.col("breaks"), F.col("runs"))).otherwise(original)
    s = s.select("doc", some.alias("some"), text.alias("text"))
    out = {"text": F.col("text")}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.col("some"), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return s.select(*[out.get(c, F.col("doc").getField(c)).alias(c) for c in cols])
