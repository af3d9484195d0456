"""Quality rules by distribution divergence (operator 1): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.llm.common import WORD, staged, table, whole

#: Base rule: fewest words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words of a window for repeats.
WINDOW = 5
#: Largest Jensen-Shannon distance (base 2, 0 to 1) to the nearest language reference.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.18, 0.38
#: Character distance from the first references up to which a document counts for the second ones, as the nearer half always does.
MOST_REFERENCE_DISTANCE = 0.16
#: Shorter texts, in characters and in words of letters, are not held against the references: their histograms say too little.
LEAST_CHARS, LEAST_TEXT_WORDS = 600, 100
#: Fewest words that a language must have in all for a reference.
LEAST_REFERENCE_WORDS = 1000

SYMBOLS = r"[#*$%&|<>]"

#: Words of a language that are counted, the share of its labelled documents that must have such a word, and the languages that get
#: a reference, those with the most labelled documents: the references of all have 400 x 16,001 numbers at most, 51 MB.
COMMON, LEAST_SHARE, MOST_LANGUAGES = 40, 0.1, 400
#: Letters that are words by themselves, as their scripts put no spaces between words: Thai to Lao, Burmese, Khmer, kana, Han.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
LETTERS = rf"[a-z\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[\p{{L}}&&[{UNSPACED}]]"

#: Classes of characters: those of ASCII, then those of all other characters, of which capitals, digits and marks join the first.
ASCII_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": "[!\"'()+,\\-./:;=?@\\[\\\\\\]^_`{}~]"}
WIDE_CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"\p{P}"}
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")
#: After these come the letters of other scripts, combining marks, and what is left: lower-case ASCII letters, and other characters beyond ASCII.
CHAR_CLASSES = ("space", "symbol", *ASCII_CLASSES, *SCRIPTS, "letter", "combining", "lower", "rest")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def letter_words(text: Column) -> Column:
    """Runs of letters in lower case; letters of scripts without spaces each by itself."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))


def common_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, int]]:
    """(word, its 64-bit hash) in order: the COMMON words of each language that most of its labelled documents have.

    Counts go over all labelled documents, each counting a word once; a word that less than LEAST_SHARE of them have isn't common.
    """
    labelled = docs.select(F.col(lang_col).alias("l"), F.array_distinct(letter_words(F.col(text_col))).alias("words")).filter(F.col("l").isNotNull() & (F.size("words") > 0))
    # the empty word stands for the document itself
    counts = staged(labelled.select("l", F.explode(F.array_append("words", F.lit(""))).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n")), "word-counts")
    languages = counts.filter("w = ''").select(F.col("l").alias("lang"), F.col("n").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGUAGES)
    often = counts.filter("w <> ''").join(F.broadcast(languages), F.col("l") == F.col("lang")).filter(F.col("n") >= LEAST_SHARE * F.col("docs"))
    ranked = often.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).filter(F.col("rank") <= COMMON)
    return sorted((r.w, r.h) for r in ranked.select("w").distinct().withColumn("h", F.xxhash64("w")).collect())


def _place(word: Column, words: list[tuple[str, int]]) -> Column:
    """The place of a word among words, from 1, or null: a hash table of literals."""
    buckets: list[list[Column]] = [[] for _ in range(2 * len(words) + 1)]
    for i, (w, h) in enumerate(words, 1):
        buckets[h % len(buckets)] += [F.lit(w), F.lit(i)]
    slots = F.array(*[(F.create_map(*b) if b else F.create_map()).cast("map<string,int>") for b in buckets])
    return F.get(slots, F.pmod(F.xxhash64(word), F.lit(len(buckets))).cast("int"))[word]


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def shares(counts: Column) -> Column:
    """Counts over their sum; null where that is 0."""
    return F.when(_total(counts) > 0, _let(F.struct(counts.alias("c"), _total(counts).alias("n")), lambda t: F.transform(t["c"], lambda x: x / t["n"])))


def present(counts: Column) -> Column:
    """(place, share) of the counts that aren't 0; null where none is."""
    placed = F.transform(shares(counts), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    return F.filter(placed, lambda e: e["x"] > 0)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distance(found: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of present() of one histogram and shares() of another.

    What only the reference has adds its share in whole, so only what is present is gone through.
    """

    def step(s: Column, e: Column) -> Column:
        def with_share(q: Column) -> Column:
            own = e["x"] * F.log2(2 * e["x"] / (e["x"] + q))
            return s + own + F.when(q > 0, q * (F.log2(2 * q / (e["x"] + q)) - 1)).otherwise(F.lit(0.0))

        return _let(F.element_at(reference, e["i"]), with_share)

    divergence = F.aggregate(found, F.lit(1.0), step)
    return F.sqrt(F.greatest(divergence / 2, F.lit(0.0)))


def hist_js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts of equal length; null where one of them sums to 0."""
    return distance(present(p), shares(q))


def measures(docs: DataFrame, keep: list[str], text_col: str = "text", words: list[tuple[str, int]] = ()) -> DataFrame:
    """keep columns; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_letter_words (long); char_hist (array<double>),
    the counts of CHAR_CLASSES; word_hist (array of place, from 1, and count): the words that the text has, and after them all others.

    All of it is computed within the row. Windows of words are compared by a 64-bit hash of their words' 64-bit hashes, so a row
    with millions of words needs no pairs of windows: equal hashes meet by sorting, and only in rows that have any.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    # the array of words is not carried further than to what is made of it
    rows = rows.select(
        *keep,
        "_text",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        letter_words(F.col("_text")).alias("_letters"),
    )
    found = F.filter(F.transform("_letters", lambda w: _place(w, words)), lambda i: i.isNotNull()) if words else F.array().cast("array<int>")
    rows = rows.select(*[c for c in rows.columns if c != "_letters"], F.size("_letters").cast("long").alias("n_letter_words"), F.sort_array(found).alias("_common"))
    c = F.col("_common")
    ends = F.filter(F.transform(c, lambda x, j: F.struct(x.alias("i"), (j + 1).alias("at"))), lambda e: F.coalesce(F.get(c, e["at"]) != e["i"], F.lit(True)))
    rows = rows.withColumn("_ends", ends)
    n = F.size("_hashes")
    h = F.col("_hashes")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_windows", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    marked = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(twice, marked))
    s = F.col("_sorted")
    paired = F.filter(s, lambda e, j: F.coalesce(F.when(j > 0, F.get(s, j - 1)["h"] == e["h"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
    rows = rows.withColumn("_places", F.sort_array(F.transform(paired, lambda e: e["i"])))
    p = F.col("_places")
    covered = F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]

    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    rows = rows.withColumns({"_lines": lines, "_spaces": F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]")).cast("long"), "n_chars": F.length(t).cast("long"), "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long")})
    # most texts are ASCII but for few characters: the classes beyond it are counted on these alone
    rows = rows.withColumn("_wide", F.when(F.octet_length(t) > F.length(t), F.regexp_replace(t, r"[\x00-\x7F]+", "")).otherwise(F.lit("")))
    wide = F.col("_wide")
    script = [rf"[\p{{L}}&&[\p{{Is{name}}}]&&[^\p{{Lu}}]]" for name in SCRIPTS]
    other = rf"[\p{{L}}&&[^\p{{Lu}}{''.join(rf'\p{{Is{name}}}' for name in SCRIPTS)}]]"
    beyond = [F.when(wide == "", F.lit(0)).otherwise(F.regexp_count(wide, F.lit(c))) for c in (*WIDE_CLASSES.values(), *script, other, r"\p{M}")]
    rows = rows.withColumns({"_ascii": F.array(*[F.regexp_count(t, F.lit(c)) for c in ASCII_CLASSES.values()]), "_beyond": F.array(*beyond)})
    joined = [(F.get("_ascii", F.lit(i)) + F.get("_beyond", F.lit(i))).cast("double") for i in range(3)]
    scripts = [F.get("_beyond", F.lit(i)).cast("double") for i in range(3, len(beyond))]
    lower = F.col("n_chars") - F.length(wide) - F.col("_spaces") - F.col("n_symbols") - F.aggregate("_ascii", F.lit(0), lambda s, x: s + x)
    left = F.length(wide) - F.aggregate("_beyond", F.lit(0), lambda s, x: s + x)
    n_common = F.size("_common")
    e = F.col("_ends")
    own = F.transform(e, lambda x, j: F.struct(x["i"].alias("i"), (x["at"] - F.coalesce(F.when(j > 0, F.get(e, j - 1)["at"]), F.lit(0))).cast("double").alias("n")))
    rest = F.array(F.struct(F.lit(len(words) + 1).alias("i"), (F.col("n_letter_words") - n_common).cast("double").alias("n")))
    return rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("_spaces")).alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("_places") > 0, covered), F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_chars",
        "n_letter_words",
        F.array(F.col("_spaces").cast("double"), F.col("n_symbols").cast("double"), *joined, *scripts, F.greatest(lower, F.lit(0)).cast("double"), F.greatest(left, F.lit(0)).cast("double")).alias("char_hist"),
        F.filter(F.concat(own, rest), lambda x: x["n"] > 0).alias("word_hist"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(measured: DataFrame, n_words: int, lang_col: str = "lang") -> DataFrame:
    """ref_lang, ref_chars, ref_words (shares): a row for each of the languages with enough labelled words, MOST_LANGUAGES at most.

    Counts are summed over all documents of the language that pass the base rule.
    """
    labelled = measured.filter(F.col(lang_col).isNotNull() & ~base_failed())
    places = range(1, len(CHAR_CLASSES) + 1)
    chars = labelled.groupBy(F.col(lang_col).alias("ref_lang")).agg(F.sum("n_letter_words").alias("_n"), F.count("*").alias("_docs"), F.array(*[F.sum(F.col("char_hist")[i - 1]) for i in places]).alias("_chars"))
    chars = chars.filter(F.col("_n") >= LEAST_REFERENCE_WORDS).orderBy(F.desc("_docs"), "ref_lang").limit(MOST_LANGUAGES)
    counts = labelled.select(F.col(lang_col).alias("_of"), F.explode("word_hist").alias("e")).groupBy("_of", F.col("e.i").alias("i")).agg(F.sum("e.n").alias("n"))
    grid = chars.select("ref_lang", F.explode(F.sequence(F.lit(1), F.lit(n_words + 1))).alias("_at"))
    filled = grid.join(counts, (F.col("ref_lang") == F.col("_of")) & (F.col("_at") == F.col("i")), "left").select(F.col("ref_lang").alias("_lang_of"), F.struct(F.col("_at"), F.coalesce("n", F.lit(0.0)).alias("n")).alias("e"))
    word_rows = filled.groupBy("_lang_of").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["n"]).alias("_words"))
    return chars.join(word_rows, F.col("ref_lang") == F.col("_lang_of")).select("ref_lang", shares(F.col("_chars")).alias("ref_chars"), shares(F.col("_words")).alias("ref_words"))


def judge(docs: DataFrame, keep: list[str] | None = None, lang_col: str = "lang", text_col: str = "text", char_limit: float = MOST_CHAR_DISTANCE, word_limit: float = MOST_WORD_DISTANCE) -> DataFrame:
    """keep columns of docs (default doc_id), the measures, base_failed, char_distance, word_distance, ref_lang, kept.

    Common words are learned from the labelled documents of any language. Each language's reference histograms are summed over all
    its labelled documents, and then once more over those of them that lie within MOST_REFERENCE_DISTANCE of the first references,
    or no farther than the middle one of their language (to three decimals), so that junk doesn't describe it. A document is compared
    with every reference, not with that of its own label; the one nearest by words counts, by characters where there are no words.
    It is kept if it passes the base rule and neither distance is over its limit; texts under LEAST_CHARS characters, or
    LEAST_TEXT_WORDS words of letters, skip that comparison (null distance), and so do all texts where no language has a reference.
    Null texts count as empty; these fail the base rule. One array of all references, of a bounded size, is joined to every row.
    Repeated rows each get a row, an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    words = common_words(docs, lang_col, text_col)
    rows = docs.select(whole(docs, keep).alias("_row"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_source_text"))
    measured = staged(measures(rows, ["_row", "_lang"], "_source_text", words), "measures")
    chars = F.col("char_hist")
    word_shares = F.transform("word_hist", lambda e: F.struct(e["i"].alias("i"), (e["n"] / F.col("n_letter_words")).alias("x")))

    def ordinary() -> DataFrame:
        """Labelled rows near the first reference of their own label."""
        first = references(measured, len(words), "_lang").select(F.col("ref_lang").alias("_of"), F.col("ref_chars").alias("_c"))
        rows = measured.join(F.broadcast(first), F.col("_lang") == F.col("_of")).drop("_of")
        far = F.when(F.col("n_chars") >= LEAST_CHARS, distance(present(chars), F.col("_c")))
        rows = staged(rows.withColumn("_far", F.round(1000 * F.coalesce(far, F.lit(0.0))).cast("int")).drop("_row", "_c"), "far")
        # the exact middle from counts of at most 1,001 values a language
        counts = rows.groupBy(F.col("_lang").alias("_of"), "_far").agg(F.count("*").alias("_n"))
        by_lang = Window.partitionBy("_of")
        upto = counts.withColumns({"_upto": F.sum("_n").over(by_lang.orderBy("_far")), "_all": F.sum("_n").over(by_lang)})
        middle = upto.filter(2 * F.col("_upto") >= F.col("_all")).groupBy("_of").agg(F.greatest(F.min("_far"), F.lit(round(1000 * MOST_REFERENCE_DISTANCE))).alias("_middle"))
        return rows.join(F.broadcast(middle), F.col("_lang") == F.col("_of")).filter("_far <= _middle").drop("_far", "_of", "_middle")

    own = F.struct(F.col("ref_lang").alias("l"), F.col("ref_chars").alias("c"), F.col("ref_words").alias("w"))
    refs = staged(references(ordinary(), len(words), "_lang").agg(F.sort_array(F.collect_list(own)).alias("_refs")), "references")
    rows = measured.crossJoin(F.broadcast(refs))
    found = F.struct(word_shares.alias("w"), present(chars).alias("c"))
    nearest = _let(found, lambda t: F.array_min(F.transform("_refs", lambda r: F.struct(F.when(F.size(t["w"]) > 0, distance(t["w"], r["w"])).alias("w"), distance(t["c"], r["c"]).alias("c"), r["l"].alias("l")))))
    rows = rows.withColumn("_near", F.when((F.col("n_words") > 0) & (F.size("_refs") > 0), nearest))
    rows = rows.withColumns(
        {
            "base_failed": base_failed(),
            "char_distance": F.when(F.col("n_chars") >= LEAST_CHARS, F.col("_near.c")),
            "word_distance": F.when(F.col("n_letter_words") >= LEAST_TEXT_WORDS, F.col("_near.w")),
            "ref_lang": F.col("_near.l"),
        }
    )
    over = (F.coalesce("char_distance", F.lit(0.0)) > char_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~over)
    return rows.select("_row.*", *[c for c in rows.columns if c not in ("_row", "_lang", "_refs", "_near") and c not in keep])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "ref_lang")
