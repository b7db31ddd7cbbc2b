"""Column functions on text: sentences, mentions, relation triples, answers, normal forms.

All are built-in expressions. `boundary` chooses how a word edge is told: "unicode"
(letters of any script are word characters) or "ascii".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = {"unicode": (r"(?U)\b", r"\b"), "ascii": ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])")}

# Words that are no entity when they stand alone.
STOPWORDS = ("The", "This", "That", "It", "They", "He", "She", "In", "On", "At", "For", "With")

# Relation patterns, their relation ({rel}: the middle group) and number of groups.
RELATIONS = (
    (r"([A-Z][A-Za-z0-9\s.]+?)\s+(?:was|is)\s+born\s+in\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+on|\s+in)", "born in", 2),
    (r"([A-Z][A-Za-z0-9\s.]+?)\s+(?:is|was)\s+(?:the|an?)\s+([A-Za-z\s]+?)\s+of\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+who|\s+which)", "is {rel} of", 3),
    (r"(?:capital|largest city)\s+(?:is|was)\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+while)", "capital is", 1),
    (r"([A-Z][A-Za-z0-9\s.]+?)\s+married\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+in)", "married", 2),
    (r"(?:was\s+)?directed\s+by\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+and)", "directed by", 1),
    (r"([A-Z][A-Za-z0-9\s.]+?)\s+directed\s+(?:the\s+film|the\s+movie\s+)?([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+and)", "directed", 2),
    (r"(?:was\s+)?produced\s+by\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+and)", "produced by", 1),
    (r"(?:was\s+)?founded\s+(?:in\s+\d{4}\s+)?by\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+in)", "founded by", 1),
    (r"(?:Headquartered|headquartered)\s+in\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+and)", "headquartered in", 1),
    (r"(?:was\s+)?educated\s+at\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+and)", "educated at", 1),
    (r"(?:received|won|earned)\s+(?:the\s+)?([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+with|\s+in)", "received award", 1),
    (r"collaborated\s+with\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+on)", "collaborated with", 1),
    (r"(?:play|novel|book|magnum opus)\s+(?:in\s+[a-z0-9\s]+\s+)?by\s+([A-Z][A-Za-z0-9\s.]+?)(?:,|\.|\s+and)", "author", 1),
)
#: What a sentence must have for each pattern above to be tried: found in one pass, while the patterns may try every capital letter.
_NEEDS = (r"born\s+in", r"\s(?:is|was)\s+(?:the|an?)\s", r"(?:capital|largest city)\s", "married", r"directed\s+by", "directed", r"produced\s+by", "founded", "eadquartered", "educated", "received|won|earned", "collaborated", r"(?:play|novel|book|magnum opus)\s")
# Answer rules as (words of the question, pattern) in order of precedence.
ANSWERS = (
    (("capital",), r"capital is ([A-Z][A-Za-z\s]+?)(?:,|\.|\s+while)"),
    (("award", "prize"), r"(?:received|won|earned|shared)\s+(?:the\s+)?(Nobel Prize in [A-Za-z]+)"),
    (("birthplace", "born"), r"born in ([A-Z][A-Za-z\s.]+?)(?:,|\.|\s+on|\s+in|\s+Germany)"),
    (("headquarter",), r"(?i)Headquartered in ([A-Z][A-Za-z\s.]+?)(?:,|\.|\s+Texas)"),
    (("directed", "director"), r"directed by ([A-Z][A-Za-z\s.]+?)(?:,|\.|\s+and)"),
    (("year", "when"), r"founded in (\d{4})"),
)
# How yes/no questions begin, names that are no answers, and what stands for no answer.
YES_NO = ("were ", "was ", "is ", "are ", "did ", "does ", "do ")
NOT_ANSWERS = ("The", "This", "That", "It", "Passage", "Context", "Answer")
NO_ANSWER = "Insufficient context to answer"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def mentions(text: Column, boundary: str = "unicode") -> Column:
    """Capitalised names in order, with repeats, without short ones and stopwords."""
    a, b = EDGE[boundary]
    found = F.regexp_extract_all(text, F.lit(rf"{a}[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*{b}"), F.lit(0))
    return F.filter(found, lambda e: (F.length(e) > 2) & ~e.isin(*STOPWORDS))


def triples(text: Column, title: Column) -> Column:
    """array<struct<subj, rel, obj>>: matches of the relation patterns, sentence by sentence, pattern by pattern."""

    none = F.expr("cast(array() as array<struct<subj:string,rel:string,obj:string>>)")

    def of(sentence: Column, needed: str, pattern: str, rel: str, groups: int) -> Column:
        return F.when(sentence.rlike("(?U)" + needed), found(sentence, pattern, rel, groups)).otherwise(none)

    def found(sentence: Column, pattern: str, rel: str, groups: int) -> Column:
        group = lambda g: F.regexp_extract_all(sentence, F.lit("(?U)" + pattern), F.lit(g))
        triple = lambda s, r, o: F.struct(strip(s).alias("subj"), r.alias("rel"), strip(o).alias("obj"))
        if groups == 1:
            return F.when(title != "", F.transform(group(1), lambda o: F.struct(title.alias("subj"), F.lit(rel).alias("rel"), strip(o).alias("obj")))).otherwise(none)
        if groups == 2:
            return F.zip_with(group(1), group(2), lambda s, o: triple(s, F.lit(rel), o))
        both = F.zip_with(group(1), group(2), lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        before, after = rel.split("{rel}")
        return F.zip_with(both, group(3), lambda x, o: triple(x["s"], F.concat(F.lit(before), strip(x["m"]), F.lit(after)), o))

    matched = F.flatten(F.transform(sentences(text), lambda s: F.flatten(F.array(*[of(s, n, *r) for n, r in zip(_NEEDS, RELATIONS, strict=True)]))))
    return F.when(text.rlike("(?U)" + "|".join(f"(?:{n})" for n in _NEEDS)), matched).otherwise(none)


def normalize_answer(c: Column, boundary: str = "unicode") -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(a|an|the)".join(EDGE[boundary]), " "), r"(?U)\s+", " "))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(c: Column, boundary: str = "unicode") -> Column:
    return _let(normalize_answer(c, boundary), _split)


def _split(normal: Column) -> Column:
    return F.when(normal == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(normal, " "))


def _numbered(words: Column) -> Column:
    """The words with a number each, which counts equal ones: multisets become sets, by one sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.flatten(F.transform(at, lambda i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s)) - i), lambda n: F.concat(F.get(s, i), F.lit(" "), n.cast("string"))))))

    return _let(F.array_sort(words), runs)


def _overlap(p: Column, g: Column) -> Column:
    """F1 of two numbered multisets: 1 if both are empty, 0 if one is."""
    both = F.size(p) + F.size(g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * F.size(F.array_intersect(p, g)) / both)


def exact_match(prediction: Column, gold: Column, boundary: str = "unicode") -> Column:
    return (normalize_answer(prediction, boundary) == normalize_answer(gold, boundary)).cast("double")


def token_f1(prediction: Column, gold: Column, boundary: str = "unicode") -> Column:
    """Harmonic mean of precision and recall on token multisets; 1 if both are empty, 0 if one is."""
    side = lambda c: _let(normalize_answer(c, boundary), lambda n: _numbered(_split(n)))
    return _let(F.struct(side(prediction).alias("p"), side(gold).alias("g")), lambda x: _overlap(x["p"], x["g"]))


def best_scores(prediction: Column, golds: Column, boundary: str = "unicode") -> Column:
    """struct<em, f1>, each the best over an array of golds. The prediction is brought to its normal form once."""
    side = lambda c: _let(normalize_answer(c, boundary), lambda n: F.struct(n.alias("n"), _numbered(_split(n)).alias("t")))
    score = lambda p, g: F.struct((p["n"] == g["n"]).cast("double").alias("em"), _overlap(p["t"], g["t"]).alias("f1"))
    each = _let(side(prediction), lambda p: F.transform(golds, lambda c: _let(side(c), lambda g: score(p, g))))
    return _let(each, lambda xs: F.struct(F.array_max(F.transform(xs, lambda x: x["em"])).alias("em"), F.array_max(F.transform(xs, lambda x: x["f1"])).alias("f1")))


def extractive_answer(question: Column, context: Column, boundary: str = "unicode") -> Column:
    """The first rule whose question words occur and whose pattern is found in the context."""
    a, b = EDGE[boundary]
    q = F.lower(question)
    has = lambda words: _any(q, words)
    multi = F.regexp_extract_all(context, F.lit(rf"{a}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+{b}"), F.lit(0))
    both = F.when(F.size(F.array_distinct(multi)) < F.size(multi), "yes").otherwise("no")
    rules = [F.when(_starts(q, YES_NO) & _any(q, ("same person", "both")), both)]
    for words, pattern in ANSWERS:
        rules.append(F.when(has(words), F.nullif(F.trim(F.regexp_extract(context, pattern, 1)), F.lit(""))))
    rules.append(F.when(has(("year", "when")), F.nullif(F.regexp_extract(context, rf"{a}(1\d{{3}}|20\d{{2}}){b}", 1), F.lit(""))))
    names = F.regexp_extract_all(context, F.lit(rf"{a}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*{b}"), F.lit(0))
    rules.append(F.get(F.filter(names, lambda e: ~q.contains(F.lower(e)) & ~e.isin(*NOT_ANSWERS)), 0))
    return F.coalesce(*rules, F.lit(NO_ANSWER))


# The parts of an answer prompt.
PROMPT = ("Retrieved Context:\n", "\n\nQuestion: ", "\n\nAnswer:")


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), context, F.lit(PROMPT[1]), question, F.lit(PROMPT[2]))


def prompt_parts(text: Column) -> Column:
    """struct<question, context> that a prompt is read back as. Where the context itself has a question line, the first one counts and ends the context."""
    q = F.regexp_extract(text, r"(?s)Question:\s*(.+?)(?:\nAnswer:|\z)", 1)
    c = F.regexp_extract(text, r"(?s)Retrieved Context:\s*(.+?)(?:\n\nQuestion:|\z)", 1)
    return F.struct(strip(q).alias("question"), F.when(c == "", text).otherwise(strip(c)).alias("context"))


def _any(q: Column, words: tuple[str, ...]) -> Column:
    found = q.contains(words[0])
    for w in words[1:]:
        found = found | q.contains(w)
    return found


def _starts(q: Column, words: tuple[str, ...]) -> Column:
    found = q.startswith(words[0])
    for w in words[1:]:
        found = found | q.startswith(w)
    return found
