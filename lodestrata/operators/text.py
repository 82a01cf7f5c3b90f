"""Claims, summaries, relations and the other operators on prose, as plans of built-in expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Abbreviations after which the claim splitter goes on.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr vs etc inc ltd co corp dept est approx vol no fig eq ref e.g i.e viz al p pp ch sec gen gov sgt cpl pvt capt lt col maj cmdr adm rev st"
).split()
# Phrases, verbs and common capitals by which claims are told.
ASSERTION_PATTERNS = "is are was were has have had can will must shall should provides supports uses requires enables implements contains includes returns accepts stores handles manages runs executes generates defaults configures limits ensures validates".split()
ASSERTIVE_VERBS = (
    "is are was were uses requires must should provides supports enables implements contains includes allows defines specifies returns accepts produces generates creates stores handles manages runs executes processes performs operates"
    " defaults configures sets limits restricts enforces validates ensures"
).split()
COMMON_CAPITALS = "The A An In On At By For To Of And Or But With From Is It As If Not No This That These Those".split()
# Words without weight in summaries.
SUMMARY_STOP = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can it its this that these those not no if so as up out about into over"
    " after also each which their there then them they than when what who how all any both more most other some such only very"
).split()
# Words that don't relate claims.
RELATION_STOP = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could must not and but or nor for yet so in on at to from by of with as into through during before after above below"
    " between under over each every all both few more most other some such no only own same than too very just that this these those it its they them their we our you your he she his her which what who whom when where how why if"
    " then also about up out any per"
).split()
# Words of contradiction and of change.
NEGATIONS = "not no never neither nor cannot doesn't don't didn't isn't aren't wasn't weren't won't wouldn't shouldn't couldn't without disable disabled removed deprecated".split()
UPDATES = "updated changed modified replaced superseded upgraded migrated new previously formerly now instead".split()
# Signs by which a text is taken for code.
CODE_MARKERS = ["fn ", "def ", "class ", "import ", "struct ", "function ", "const ", "#include", "public ", "impl ", "return "]
CODE_SIGNS = ["{", "}", ";", "=>", "->", "()", "::"]

_CUT, _MASK = "\u0001", "\u0002"


def masked_pattern() -> str:
    """Abbreviations with their dot, as one expression for both engines."""
    return r"(?i)(^|[ \n\t])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\."


def claim_sentences(text: Column) -> Column:
    """Sentences for claims: cut after . ! ? before a capital or a quote, not after an abbreviation."""
    masked = F.regexp_replace(text, masked_pattern(), "$1$2" + _MASK)
    cut = F.regexp_replace(masked, r"([.!?])(\s*)([\p{Lu}\"])", "$1" + _CUT + "$2$3")
    parts = F.transform(F.split(cut, _CUT), lambda s: F.regexp_replace(F.replace(s, F.lit(_MASK), F.lit(".")), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def summary_sentences(text: Column) -> Column:
    """Sentences for summaries: cut after . ! ? before a capital."""
    cut = F.regexp_replace(text, r"([.!?])(\s*)(\p{Lu})", "$1" + _CUT + "$2$3")
    return F.filter(F.transform(F.split(cut, _CUT), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _in(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def assertion_score(sentence: Column) -> Column:
    words = _words(sentence)
    low = F.lower(sentence)
    trimmed = F.transform(_words(low), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    patterns = F.lit(False)
    for p in ASSERTION_PATTERNS:
        patterns = patterns | low.contains(f" {p} ")
    named = F.exists(F.slice(words, 2, 10_000_000), lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}") & (F.octet_length(w) > 1) & ~_in(w, COMMON_CAPITALS))
    score = F.when(F.exists(words, lambda w: w.rlike("[0-9]")), 2).otherwise(0) + F.exists(trimmed, lambda w: _in(w, ASSERTIVE_VERBS)).cast("int") + named.cast("int") + patterns.cast("int")
    return F.when(sentence.endswith("?"), 0).otherwise(score)


def claims(sections: DataFrame, min_words: int = 4, max_words: int = 60) -> DataFrame:
    """(claim_id, section_id, text, position) of the factual claims; positions count after filtering."""
    kept = F.filter(claim_sentences(F.col("text")), lambda s: (F.size(_words(s)) >= min_words) & (F.size(_words(s)) <= max_words) & (assertion_score(s) >= 2))
    rows = sections.select(F.col("id").alias("section_id"), F.posexplode(kept).alias("position", "text"))
    return rows.select(F.concat("section_id", F.lit(":c"), F.col("position").cast("string")).alias("claim_id"), "section_id", "text", "position")


def summary_tokens(sentence: Column) -> Column:
    plain = F.transform(_words(sentence), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(plain, lambda w: (w != "") & ~_in(w, SUMMARY_STOP))


def summaries(sections: DataFrame, k: int = 3, id_col: str = "id") -> DataFrame:
    """(id, summary): the k sentences of greatest mean tf-idf, in their order; all where there are no more than k.

    Everything is aggregated by document, so a text is read once and nothing but
    its own sentences is shuffled with it.
    """
    sentences = sections.select(F.col(id_col).alias("id"), F.posexplode(summary_sentences(F.col("text"))).alias("pos", "sentence"))
    tokens = sentences.withColumn("tokens", summary_tokens(F.col("sentence")))
    n = Window.partitionBy("id")
    terms = tokens.select("id", "pos", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    tf = terms.groupBy("id", "pos", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.withColumn("df", F.count("*").over(Window.partitionBy("id", "term")))
    counts = sentences.groupBy("id").agg(F.count("*").alias("n"))
    scored = df.join(counts, "id").groupBy("id", "pos").agg(F.round(F.sum(F.col("tf") / F.col("len") * F.log(F.col("n") / F.col("df"))) / F.first("len"), 9).alias("score"))
    ranked = sentences.join(scored, ["id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))).where(F.col("r") <= k)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))


def significant_terms(text: Column) -> Column:
    plain = F.transform(_words(text), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_\-]", ""))
    kept = F.filter(plain, lambda w: (F.octet_length(w) >= 2) & ~_in(F.lower(w), RELATION_STOP) & (w.rlike("[0-9]") | w.rlike(r"^\p{Lu}") | (F.octet_length(w) >= 4)))
    return F.array_distinct(F.transform(kept, lambda w: F.lower(w)))


def relations(claims_df: DataFrame, min_shared: int = 2) -> DataFrame:
    """(source_claim_id, target_claim_id, relation_type, confidence) of claims of one document that share terms.

    ``claims_df``: claim_id, document_id, section_id, ord, text.  Pairs come from
    an equi-join on (document, term), never from a product of claims.
    """
    base = claims_df.withColumn("terms", significant_terms(F.col("text"))).withColumn("n", F.size("terms"))
    terms = base.select("document_id", "claim_id", "section_id", "ord", F.explode("terms").alias("term"))
    a, b = terms.alias("a"), terms.alias("b")
    shared = (
        a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.ord") < F.col("b.ord")) & (F.col("a.section_id") != F.col("b.section_id")))
        .groupBy(F.col("a.claim_id").alias("source_claim_id"), F.col("b.claim_id").alias("target_claim_id")).agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    )
    left = base.select(F.col("claim_id").alias("source_claim_id"), F.col("text").alias("ta"), F.col("n").alias("na"))
    right = base.select(F.col("claim_id").alias("target_claim_id"), F.col("text").alias("tb"), F.col("n").alias("nb"))
    j = shared.join(left, "source_claim_id").join(right, "target_claim_id")
    return j.select("source_claim_id", "target_claim_id", relation_type(F.col("ta"), F.col("tb")).alias("relation_type"), F.least(F.lit(1.0), F.col("shared") / F.least("na", "nb")).alias("confidence"))


def related(relations_df: DataFrame, claim_ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(claim_id, other_id, relation_type, confidence): relations of claims in both directions."""
    r = relations_df.where(F.col("relation_type").isin(*types)) if types else relations_df
    both = r.select(F.col("source_claim_id").alias("claim_id"), F.col("target_claim_id").alias("other_id"), "relation_type", "confidence").unionByName(r.select(F.col("target_claim_id").alias("claim_id"), F.col("source_claim_id").alias("other_id"), "relation_type", "confidence"))
    return both.join(claim_ids.select("claim_id"), "claim_id", "left_semi")


def _negated(text: Column) -> Column:
    return F.exists(F.transform(_words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: _in(w, NEGATIONS))


def relation_type(a: Column, b: Column) -> Column:
    update = F.lit(False)
    for w in UPDATES:
        update = update | F.lower(a).contains(w) | F.lower(b).contains(w)
    return F.when(_negated(a) != _negated(b), "contradicts").when(update, "updates").otherwise("references")


def paragraphs(sections: DataFrame, min_words: int = 500) -> DataFrame:
    """(section_id, piece, text): large sections without a heading, split at blank lines; all others whole."""
    words = F.size(_words(F.col("text")))
    parts = F.filter(F.transform(F.split("text", r"\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    split = (F.col("depth") == 0) & (words > min_words) & (F.size(parts) >= 2)
    return sections.select(F.col("id").alias("section_id"), F.posexplode(F.when(split, parts).otherwise(F.array("text"))).alias("piece", "text"))


def coalesced(sections: DataFrame, min_tokens: int = 50) -> DataFrame:
    """(document_id, group, first_position, n_sections, text): neighbours of one depth are merged while both are small.

    Sections are streamed in their order, document by document; what is held is
    one group, which grows only while it is small, however long a document is.
    """
    heading = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    count = lambda c: F.size(_words(c))
    rows = sections.dropDuplicates(["id"]).select("document_id", "position", "id", "depth", F.coalesce("text", F.lit("")).alias("text"), heading.alias("heading"))
    rows = rows.withColumn("words", count(F.col("text"))).withColumn("more", F.when(F.col("heading") != "", count(F.col("heading")) + 1).otherwise(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["document_id", "group", "first_position", "n_sections", "text"]
        now: list | None = None  # document, group, first position, sections, texts, words, depth
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if now and now[0] == r.document_id and now[6] == r.depth and now[5] < min_tokens and r.words < min_tokens:
                    now[3] += 1
                    now[4].append((f"### {r.heading}\n" if r.heading else "") + r.text)
                    now[5] += r.words + r.more
                    continue
                if now:
                    out.append((*now[:4], "\n\n".join(now[4])))
                now = [r.document_id, now[1] + 1 if now and now[0] == r.document_id else 0, r.position, 1, [r.text], r.words, r.depth]
            yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([(*now[:4], "\n\n".join(now[4]))], columns=names)

    ordered = rows.repartition("document_id").sortWithinPartitions("document_id", "position", "id")
    return ordered.mapInPandas(run, "document_id string, group int, first_position int, n_sections int, text string")


def looks_like_code(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    marker = F.lit(False)
    for m in CODE_MARKERS:
        marker = marker | text.contains(m)

    def sign(x: Column) -> Column:
        out = F.lit(False)
        for s in CODE_SIGNS:
            out = out | x.contains(s)
        return out

    return marker | ((F.size(lines) > 0) & (F.size(F.filter(lines, sign)) >= 0.3 * F.size(lines)))


def contextualised(text: Column, headings: Column) -> Column:
    """Headings joined before the text, once; the first is cut to its last path part."""
    first = F.regexp_extract(F.element_at(headings, 1), r"([^/]*)$", 1)
    crumbs = F.array_join(F.concat(F.array(first), F.slice(headings, 2, 1_000_000)), " › ")
    head = F.concat(crumbs, F.lit("\n\n"))
    return F.when((F.coalesce(F.size(headings), F.lit(0)) > 0) & ~text.startswith(head), F.concat(head, text)).otherwise(text)


def compression_quality(pairs: DataFrame) -> DataFrame:
    """(id, ratio, retention, quality) of (id, original, compressed) by words and significant terms."""
    words = lambda c: F.size(_words(F.col(c)))
    a, b = significant_terms(F.col("original")), significant_terms(F.col("compressed"))
    base = pairs.select("id", words("original").alias("wo"), words("compressed").alias("wc"), F.size(a).alias("ta"), F.size(b).alias("tb"), F.size(F.array_intersect(a, b)).alias("both"))
    ratio = F.when(F.col("wo") > 0, F.col("wc") / F.col("wo")).otherwise(1.0)
    retention = F.when(F.col("ta") > 0, F.col("both") / F.col("ta")).otherwise(1.0)
    density = F.when(F.col("wc") > 0, F.col("tb") / F.col("wc")).otherwise(0.0)
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 * retention + 0.3 * (1 - ratio) + 0.1 * density))
    return base.select("id", F.round(ratio, 6).alias("ratio"), F.round(retention, 6).alias("retention"), F.round(quality, 6).alias("quality"))


def term_index(claims_df: DataFrame) -> DataFrame:
    """(term, claim_id): the inverted index of the claims' significant terms, a row a posting."""
    return claims_df.select("claim_id", F.explode(significant_terms(F.col("text"))).alias("term")).select("term", "claim_id")


# --- ways to compress a text ---------------------------------------------------------

# Endings that mark the id of code, and with what a line of a definition begins.
CODE_ENDINGS = [".rs", ".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".swift", ".kt", ".scala", ".zig", ".lua", ".sh", ".bash", ".toml", ".yaml", ".yml", ".json"]
DEFINITION_PREFIXES = ["pub ", "fn ", "struct ", "impl ", "trait ", "enum ", "type ", "const ", "def ", "class ", "func ", "function "]


def shorter(made: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, compressed) of what was made where it is shorter than the text."""
    return made.join(texts.select("id", "text"), "id").where("octet_length(compressed) < octet_length(text)").select("id", "compressed")


def salient_summaries(sections: DataFrame, keywords: list[str], k: int = 3) -> DataFrame:
    """(id, compressed): of the 2k best sentences first those with a keyword, in their order, then the others, k in all; only of texts with more than k sentences."""
    if not keywords:
        return shorter(summaries(sections, k).withColumnRenamed("summary", "compressed"), sections)
    long = sections.where(F.size(summary_sentences(F.col("text"))) > k)
    parts = summaries(long, 2 * k).select("id", F.posexplode(summary_sentences(F.col("summary"))).alias("pos", "sentence"))
    hit = functools.reduce(lambda a, b: a | b, [F.lower("sentence").contains(w) for w in keywords])
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.when(hit, 0).otherwise(1), "pos"))
    best = parts.withColumn("r", order).where(F.col("r") <= k)
    made = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"]), " ").alias("compressed"))  # k entries
    return shorter(made, sections)


def structured_claims(sections: DataFrame) -> DataFrame:
    """(id, compressed): the claims of a text, joined."""
    c = claims(sections).groupBy(F.col("section_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " | ").alias("compressed"))
    return shorter(c, sections)


def code_outline(text: Column) -> Column:
    """Of more than five lines of code: the doc comment and the definition after it, or the lines down to the first definition or blank line."""
    lines = F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    starts = lambda x, prefixes: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.trim(x), p))
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("doc"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        bare = F.trim(x)
        doc = starts(x, ["///", "//!", "#"])
        signature = acc["doc"] & ~doc & (bare != "") & ~bare.startswith("//")
        blank = ~acc["doc"] & ~doc & (bare == "") & (F.size(acc["kept"]) > 0)
        plain = ~acc["doc"] & ~doc & ~blank
        keep = ~acc["done"] & (doc | signature | plain)
        done = acc["done"] | signature | blank | (plain & starts(x, DEFINITION_PREFIXES))
        return F.struct((acc["n"] + 1).alias("n"), (acc["doc"] | (doc & ~acc["done"])).alias("doc"), done.alias("done"), F.when(keep, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.when(F.size(lines) <= 5, text).otherwise(F.array_join(F.aggregate(lines, state, step)["kept"], "\n"))


def compressed_by_kind(contents: DataFrame, k: int = 3) -> DataFrame:
    """(id, method, compressed) of contents (id, text): claims stay as they are, ids of code are outlined, all else is summarised."""
    low = F.lower("id")
    code = functools.reduce(lambda a, b: a | b, [low.contains(e) for e in CODE_ENDINGS])
    typed = contents.where("text is not null").withColumn("_kind", F.when(F.col("id").rlike(r":c\d+$"), "claim").when(code, "code").otherwise("prose"))
    prose, source = typed.where("_kind = 'prose'"), typed.where("_kind = 'code'")
    made = shorter(summaries(prose, k).withColumnRenamed("summary", "compressed"), prose).withColumn("method", F.lit("extractive"))
    outlined = shorter(source.select("id", code_outline(F.col("text")).alias("compressed")), source).withColumn("method", F.lit("code_summary"))
    return made.unionByName(outlined).select("id", "method", "compressed")


def abstractive(sections: DataFrame, model: Callable[[list[str]], list[str | None]] | None, k: int = 3) -> DataFrame:
    """(id, method, compressed): what a model makes of a text; the best sentences where there is no model or it gives nothing shorter."""
    fallback = shorter(summaries(sections.where("text is not null"), k).withColumnRenamed("summary", "compressed"), sections).withColumn("method", F.lit("extractive"))
    if model is None:
        return fallback.select("id", "method", "compressed")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.tolist()), dtype=object, index=texts.index)

    made = shorter(sections.where("text is not null").select("id", run("text").alias("compressed")).where("compressed is not null"), sections).withColumn("method", F.lit("abstractive"))
    return made.unionByName(fallback.join(made.select("id"), "id", "left_anti")).select("id", "method", "compressed")
