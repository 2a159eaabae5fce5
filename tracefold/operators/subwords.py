"""Sub-word tokens of identifiers: training, encoding and decoding as joins over distinct words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.literals import let
from tracefold.operators.ordering import number_rows
from tracefold.session import cut, spread

#: Most candidates looked at per round of training.
AHEAD = 64
#: Parts of a hot word or token when coded words meet their texts.
SALTS = 16
END = "</w>"


def split_identifier(text: Column) -> Column:
    """Lower-case parts of an identifier, split on underscores and camel case."""
    runs = F.transform(F.split(text, "_+"), lambda part: let(
        F.regexp_extract_all(part, F.lit(rules.RE_IDENTIFIER_RUN), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(part))))
    return F.filter(F.transform(F.flatten(runs), F.lower), lambda part: part != "")


def spaced(word: Column) -> Column:
    """Characters of a word separated by blanks, with the end mark."""
    return F.concat(F.regexp_replace(word, r"([\s\S])", "$1 "), F.lit(END))


def word_counts(texts: DataFrame) -> DataFrame:
    return (texts.select(F.explode(split_identifier(F.col("text"))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


# --- training ----------------------------------------------------------------------------------

def pairs_of(symbols: Column) -> Column:
    """Neighbouring symbols as (left, right)."""
    return let(F.filter(F.split(symbols, " +"), lambda s: s != ""), lambda parts: F.when(F.size(parts) > 1, F.zip_with(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")))))


def apply_merges(symbols: Column, merges: list[tuple[str, str]]) -> Column:
    """The merges one after the other, each as a text replacement."""
    for left, right in merges:
        symbols = F.replace(symbols, F.lit(f"{left} {right}"), F.lit(left + right))
    return symbols


def changes(state: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """(step, left, right, n): how the count of every pair changes at each of the merges.

    Only words that hold one of the merges are taken apart, once before and once after
    every step that changes them.
    """
    steps = F.array(*[F.struct(F.lit(f"{a} {b}").alias("pair"), F.lit(a + b).alias("merged")) for a, b in merges])
    touched = state.where(F.exists(F.transform(steps, lambda m: m["pair"]), lambda p: F.col("symbols").contains(p)))
    states = F.aggregate(steps, F.array("symbols"), lambda seen, m: F.concat(seen, F.array(
        F.replace(F.element_at(seen, -1), m["pair"], m["merged"]))))
    moves = touched.select("freq", states.alias("states")).select(
        "freq", F.explode(F.filter(F.zip_with(
            F.sequence(F.lit(1), F.lit(len(merges))), "states",
            lambda i, before: F.struct(i.alias("step"), before.alias("before"),
                                       F.get("states", i).alias("after"))),
            lambda m: m["step"].isNotNull() & (m["before"] != m["after"]))).alias("m"))
    signed = moves.select("m.step", F.explode(F.array(
        F.struct((-F.col("freq")).alias("n"), pairs_of(F.col("m.before")).alias("pairs")),
        F.struct(F.col("freq").alias("n"), pairs_of(F.col("m.after")).alias("pairs")))).alias("s"))
    return (signed.select("step", "s.n", F.explode("s.pairs").alias("p"))
            .groupBy("step", "p.left", "p.right").agg(F.sum("n").alias("n")).where("n <> 0"))


def confirmed(counts: DataFrame, moved: DataFrame, top: list[tuple]) -> int:
    """How many of the candidates are the choice of one merge at a time.

    After ``s`` merges the next choice is the best of the candidates and of all pairs whose
    count has changed; a pair outside both still ranks behind the last candidate, so a choice
    that does not rank behind it is certain.
    """
    spark = counts.sparkSession
    ahead = spark.createDataFrame([(a, b) for _, a, b in top], "left string, right string")
    watched = moved.select("left", "right").unionByName(ahead).distinct()
    base = (watched.join(counts, ["left", "right"], "left")
            .select("left", "right", F.coalesce("n", F.lit(0)).alias("base")))
    steps = F.sequence(F.lit(1), F.lit(len(top) - 1))
    shifts = moved.select("left", "right", F.explode(steps).alias("after"),
                          F.when(F.col("step") <= F.col("after"), F.col("n")).otherwise(0).alias("n"))
    now = (base.select("left", "right", F.explode(steps).alias("after"), F.col("base").alias("n"))
           .unionByName(shifts).groupBy("left", "right", "after").agg(F.sum("n").alias("n")))
    best = now.groupBy("after").agg(F.min(F.struct((-F.col("n")).alias("n"), "left", "right")).alias("b"))
    found = {r["after"]: (-r["b"]["n"], r["b"]["left"], r["b"]["right"]) for r in best.collect()}  # AHEAD rows
    rank = lambda pair: (-pair[0], pair[1], pair[2])
    count = 1
    while count < len(top) and found[count][1:] == top[count][1:] and found[count][0] > 0 \
            and rank(found[count]) <= rank(top[-1]):
        count += 1
    return count


def bpe_train(texts: DataFrame, num_merges: int, cut_every: int = 4, ahead: int = AHEAD) -> DataFrame:
    """Learn ``num_merges`` merges from a corpus: (rank, left, right, merged).

    The merge of a step is the most frequent pair, ties by smallest text.  Pair counts are
    kept as a table and changed by the words that a merge touches.  A round looks ahead: it
    follows the best candidates (twice as many as the last round accepted) one after the other
    through the words that hold them and accepts as many as one merge at a time would have
    chosen, so rounds are fewer than merges.
    """
    spark = texts.sparkSession
    state = spread(cut(word_counts(texts).select(spaced(F.col("word")).alias("symbols"), "freq")), "symbols")
    counts = cut(state.select("freq", F.explode(pairs_of(F.col("symbols"))).alias("p"))
                 .groupBy("p.left", "p.right").agg(F.sum("freq").alias("n")))
    merges: list[tuple[str, str]] = []
    rounds, good = 0, 2
    while len(merges) < num_merges:
        rows = counts.orderBy(F.desc("n"), "left", "right").limit(min(ahead, 2 * good + 2)).collect()
        top = [(r["n"], r["left"], r["right"]) for r in rows]
        if not top:
            break
        pairs = [pair[1:] for pair in top]
        moved = cut(changes(state, pairs))
        good = min(confirmed(counts, moved, top) if len(top) > 1 else 1, num_merges - len(merges))
        merges += pairs[:good]
        if len(merges) == num_merges:
            break
        state = state.withColumn("symbols", apply_merges(F.col("symbols"), pairs[:good]))
        counts = cut(counts.unionByName(moved.where(F.col("step") <= good).drop("step"))
                     .groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"))
        rounds += 1
        if rounds % cut_every == 0:
            state = spread(cut(state), "symbols")
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(merges)],
                                 "rank int, left string, right string, merged string")


def bpe_vocab(merges: DataFrame) -> DataFrame:
    """Base characters and merged tokens with ids in order of first appearance."""
    spark = merges.sparkSession
    base = spark.createDataFrame(list(enumerate(rules.BPE_BASE_TOKENS)), "token_id int, token string")
    new = (merges.groupBy(F.col("merged").alias("token")).agg(F.min("rank").alias("rank"))
           .join(base.select("token"), "token", "left_anti"))
    numbered = number_rows(new, ["rank"], None, "place").select(
        (F.col("place") + len(rules.BPE_BASE_TOKENS)).cast("int").alias("token_id"), "token")
    return base.unionByName(numbered)


# --- encoding and decoding -----------------------------------------------------------------------

def merged_words(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(word, symbols): every distinct word after the merges, by rank.

    A merge can touch a word only when its merged token stands in the word (end mark
    included), so a join on the substrings of the word finds its merges.
    """
    longest = merges.agg(F.max(F.length("merged"))).first()[0] or 0  # one number
    whole = words.select("word", F.concat("word", F.lit(END)).alias("text"))
    size = F.least(F.length("text"), F.lit(longest))
    parts = (whole.select("word", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"), size.alias("size"))
             .where(F.col("size") > 1)
             .select("word", F.explode(F.transform(
                 F.expr("sequence(2, greatest(2, least(size, length(text) - at + 1)))"),
                 lambda n: F.substring("text", F.col("at"), n))).alias("merged")).distinct())
    own = (parts.join(merges, "merged").groupBy("word").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.concat_ws(" ", "left", "right").alias("pair"), "merged"))).alias("steps")))
    return words.join(own, "word", "left").select("word", F.aggregate(
        F.coalesce("steps", F.expr("cast(array() as array<struct<rank: int, pair: string, merged: string>>)")),
        spaced(F.col("word")), lambda w, m: F.replace(w, m["pair"], m["merged"])).alias("symbols"))


def salted(rows: DataFrame, key: str) -> DataFrame:
    """Spread equal keys over :data:`SALTS` parts."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(key, "text_id", "pos"), F.lit(SALTS)))


def replicated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))


def bpe_encode(texts: DataFrame, merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token ids of each text; every distinct word is encoded once.

    A token outside the vocabulary is given by its characters, those by the unknown id.  Texts
    without words have no row.
    """
    unk = rules.BPE_BASE_TOKENS.index("<unk>")
    words = cut(texts.select("text_id", F.posexplode(split_identifier(F.col("text"))).alias("pos", "word")))
    done = merged_words(words.select("word").distinct(), merges)
    tokens = done.select("word", F.posexplode(F.filter(
        F.split("symbols", " +"), lambda t: t != "")).alias("tpos", "token"))
    known = tokens.join(vocab, "token", "left")
    units = known.select("word", "tpos", F.posexplode(
        F.when(F.col("token_id").isNotNull(), F.array("token"))
        .otherwise(F.regexp_extract_all("token", F.lit(r"[\s\S]"), F.lit(0)))).alias("cpos", "token"))
    coded = (units.join(vocab, "token", "left").groupBy("word")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "tpos", "cpos", F.coalesce("token_id", F.lit(unk)).alias("id")))).alias("ids"))
             .select("word", F.transform("ids", lambda e: e["id"]).alias("ids")))
    met = salted(words, "word").join(replicated(coded), ["word", "salt"])
    # One list per text, as long as the text itself.
    return (met.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
            .select("text_id", F.flatten(F.transform("parts", lambda e: e["ids"])).alias("token_ids")))


def bpe_decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Text of token ids, without end marks and blanks."""
    ids = encoded.select("text_id", F.posexplode("token_ids").alias("pos", "token_id"))
    tokens = (salted(ids, "token_id").join(replicated(vocab), ["token_id", "salt"], "left")
              .groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(
                  "pos", F.coalesce("token", F.lit("<unk>")).alias("token")))).alias("parts")))
    text = F.array_join(F.transform("parts", lambda e: e["token"]), "")
    return tokens.select("text_id", F.replace(
        F.replace(text, F.lit(END), F.lit(" ")), F.lit(" "), F.lit("")).alias("text"))
