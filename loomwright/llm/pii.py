"""Personal data: base patterns, and information-theoretic sanitisation of the words of the same documents.

Only DataFrame operations are used. Base spans are found by regular expressions, whose places are
added up from the pieces between the matches. Every base span is a protected entity (its normalised
value). Over the whole corpus it is counted how many documents have the entity, the term, and both,
wherever in their texts. The pointwise mutual information of term and entity, as a share of the
entity's own information, is how much of the entity the term discloses: from ``GENERALISED`` on a
term is generalised, from ``REMOVED`` on removed, everywhere in the documents that have the entity.
To generalise a term is to leave only its class, the words of the corpus that begin with the same
``CLASS`` letters; if the class itself discloses the entity, the term is removed. Only entities that
occur in different surroundings are judged, and only terms that occur with different ones of these,
so copies of one passage do not make their words suspicious.

A term that discloses a share of at least ``GENERALISED`` is in at most D (n_e / D) ** GENERALISED of
the D documents if the entity is in n_e, so no frequent word is ever paired with an entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import pick, stored

KINDS = ("email", "ip", "card", "phone", "removed_term", "generalised_term")
#: Shares of an entity's information.
REMOVED, GENERALISED = 0.9, 0.6
#: Code points on either side of an entity, up to the next match of its kind, that are its surroundings.
NEAR = 60
#: Letters by which words are put into classes, and least letters of a term.
CLASS, LEAST_LETTERS = 3, 3
#: Rows (of about 100 bytes) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_MARKS = "array<struct<start:int,kind:int,end:int>>"

# The patterns match what the plain ones of the docstring below do, but start only where a match
# can start, and never give back what they took, so that no text takes quadratic time.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string,scene:bigint>>"
#: Matches whose places are added up at a time, so that many matches take linear time.
BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern, left to right, as structs of start, kind, end, value and scene.

    scene is a hash of the surroundings: up to NEAR + 1 code points of the text between this match and
    the ones beside it; where that is all of the text between, a space marks its outer end.
    """
    near = F.lit(NEAR + 1)

    def span(piece: Column, gap: Column, behind: Column) -> Column:
        left = F.when(F.length(gap) <= NEAR, F.concat(F.lit(" "), gap)).otherwise(F.substring(gap, F.length(gap) - NEAR, near))
        right = F.when(F.length(behind) <= NEAR, F.concat(behind, F.lit(" "))).otherwise(F.substring(behind, F.lit(1), near))
        return F.struct(F.length(gap).alias("gap"), F.length(piece).alias("size"), piece.alias("value"), F.xxhash64(left, right).alias("scene"))

    def spans(gaps: Column) -> Column:
        sides = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.slice(gaps, F.lit(2), F.size(gaps)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sides, lambda m, g: span(m, g["a"], g["b"]))

    def block(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def add(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + x["size"]
            new = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"), x["scene"].alias("scene"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(new)).alias("out"))

        return F.aggregate(part, start, add)

    def placed(parts: Column) -> Column:
        offsets = F.aggregate(
            parts, F.array(F.lit(0)), lambda out, part: F.concat(out, F.array(F.element_at(out, -1) + part["at"]))
        )
        moved = lambda x, by: F.struct(
            (x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["value"].alias("value"), x["scene"].alias("scene")
        )
        return F.flatten(F.zip_with(parts, F.slice(offsets, F.lit(1), F.size(parts)), lambda part, by: F.transform(part["out"], lambda x: moved(x, by))))

    def blocks(found: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
        parts = F.transform(numbers, lambda k: block(F.slice(found, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(_let(parts, placed))

    return _let(_let(F.split(text, pattern, -1), spans), blocks)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backwards = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    counted = F.transform(backwards, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(counted, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(span: Column, kind: str) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text, as structs (start, kind as a number, end, value) by start, then kind.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip
    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255; card ``[0-9]([\\x20-]?[0-9])+``, 12 to 19
    digits that pass Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits. For each kind the
    matches are leftmost and do not overlap, and those that fail their test are dropped.
    """
    likely = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}
    each = []
    for n, (kind, pattern) in enumerate(_PATTERNS.items()):
        valid = F.filter(_found(text, pattern, n), lambda span: _valid(span, kind))  # noqa: B023 (called at once)
        each.append(F.when(likely[kind], valid).otherwise(F.array().cast(_SPAN)))
    together = F.concat(*each)
    return F.when(F.size(together) > 1, F.array_sort(together)).otherwise(together)


def _entity(span: Column) -> Column:
    """The normalised value that a base span stands for."""
    plain = F.when(span["kind"].isin(KINDS.index("card"), KINDS.index("phone")), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), plain)


def _tokens(text: Column) -> Column:
    """The distinct terms of a text, in lower case, and their classes; words inside e-mail addresses are none."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, _PATTERNS["email"], " ")).otherwise(text)
    words = F.filter(F.split(F.lower(plain), r"[^\p{L}]+"), lambda w: F.length(w) >= LEAST_LETTERS)
    return F.array_distinct(F.concat(words, F.transform(words, _class)))


def _class(word: Column) -> Column:
    return F.concat(F.substring(word, 1, CLASS), F.lit("*"))


def _sized(df: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _most(documents: int, n_e: Column) -> Column:
    """The most documents that a term may be in, to disclose GENERALISED of an entity that is in n_e."""
    return F.pow(F.lit(float(documents)), F.lit(1 - GENERALISED)) * F.pow(n_e.cast("double"), F.lit(GENERALISED)) * (1 + 1e-9)


def disclosing(held: DataFrame, texts: DataFrame, documents: int) -> DataFrame:
    """(entity, term, kind) of the terms that disclose at least GENERALISED of an entity.

    ``held`` has a row (digest, entity, copies, s1, s2) for each text that has an entity: how many
    documents have that text, and the least and the greatest scene of the entity in it; ``texts`` has
    a row (digest, body) for each document. ``kind`` is a place in KINDS.
    """
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.min("s1").alias("s1"), F.max("s2").alias("s2"))
    entities = stored(entities.where((F.col("s1") != F.col("s2")) & (F.col("n_e") >= 2) & (F.col("n_e") < documents)).select("entity", "n_e"), "entities")
    greatest = entities.agg(F.max("n_e")).first()[0]
    nothing = held.sparkSession.createDataFrame([], "entity string, term string, kind int")
    if greatest is None:
        return nothing
    bearers = stored(held.join(_sized(entities), "entity"), "bearers")
    counts = texts.select(F.explode(_tokens(F.col("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = stored(counts.where((F.col("n_t") >= 2) & (F.col("n_t") <= _most(documents, F.lit(greatest)))), "rare-terms")
    bodies = texts.join(_sized(stored(bearers.select("digest").distinct(), "bearing-texts")), "digest", "left_semi").groupBy("digest").agg(F.first("body").alias("body"))
    terms = bodies.select("digest", F.explode(_tokens(F.col("body"))).alias("term")).join(_sized(counts), "term")
    terms = stored(terms, "held-terms")
    met = bearers.join(terms, "digest").where(F.col("n_t") <= _most(documents, F.col("n_e")))
    met = met.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("copies").alias("n_te"), F.min("s1").alias("s1"), F.max("s2").alias("s2"))
    information = F.log2(F.lit(float(documents)) / F.col("n_e"))
    mutual = F.log2(F.lit(float(documents)) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    told = met.where((F.col("s1") != F.col("s2")) & (F.col("n_te") >= 2)).select("entity", "term", (mutual / information).alias("share"))
    told = stored(told.where(F.col("share") >= GENERALISED), "disclosing")
    classes = told.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("class"), F.lit(True).alias("tells"))
    words = told.where(~F.col("term").endswith("*")).withColumn("class", _class(F.col("term"))).join(classes, ["entity", "class"], "left")
    removed = (F.col("share") >= REMOVED) | F.col("tells").isNotNull()
    return words.select("entity", "term", F.when(removed, KINDS.index("removed_term")).otherwise(KINDS.index("generalised_term")).alias("kind"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (MD5 of the text), and all spans of each document.

    ``spans`` holds structs (start, kind, end) in code points, end exclusive, by start, then kind: the
    base spans (see base_spans) and all occurrences, outside e-mail addresses, of terms that disclose
    an entity of the document. Kinds are places in KINDS; of a term that several entities make
    suspicious the strictest counts. Null texts count as empty and have none. Every row counts as a
    document, also if its id or text repeats or is null; rows of equal texts have equal spans. Time
    grows with the length of a very long text, and a little more with the number of its spans. An
    empty table gives an empty result; columns are found by exact name, and others, whatever their
    names, are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.md5(F.col("body").cast("binary")))
    found = stored(rows.select("doc_id", "digest", base_spans(F.col("body")).alias("base")), "base-spans")
    distinct = found.where(F.size("base") > 0).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("base").alias("base"))
    distinct = stored(distinct, "texts-with-spans")
    held = distinct.select("digest", "copies", F.explode("base").alias("s")).groupBy("digest", _entity(F.col("s")).alias("entity"))
    held = stored(held.agg(F.first("copies").alias("copies"), F.min("s.scene").alias("s1"), F.max("s.scene").alias("s2")), "entities-of-texts")
    told = stored(disclosing(held, rows.select("digest", "body"), found.count()), "told")
    marks = stored(held.join(_sized(told), "entity").groupBy("digest", "term").agg(F.min("kind").alias("kind")), "told-terms")
    marked = _sized(stored(marks.select("digest").distinct(), "marked-texts"))
    bodies = rows.join(marked, "digest", "left_semi").groupBy("digest").agg(F.first("body").alias("body")).join(distinct, "digest")
    emails = F.filter("base", lambda s: s["kind"] == KINDS.index("email"))
    blank = _replaced(F.col("body"), emails, lambda inside, span: F.repeat(F.lit(" "), span["end"] - span["start"]))
    words = bodies.select("digest", F.explode(_found(blank, rf"\p{{L}}{{{LEAST_LETTERS},}}+", 0)).alias("w"))
    words = words.select("digest", F.lower("w.value").alias("term"), "w.start", "w.end").join(_sized(marks), ["digest", "term"])
    terms = words.groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    terms = _sized(stored(terms, "term-spans"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast(_MARKS)))))
    return found.join(terms, "digest", "left").select("doc_id", "digest", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _replaced(text: Column, found: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with ``mark(inside, span)`` in the place of each span; of spans that overlap the first one's.

    ``found`` are the spans, sorted by start. They are worked on in about as many blocks as a block has spans:
    every block is cut out of the text once, and its spans out of the block, so the text is not gone
    through from its start for every span.
    """
    reach = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

    def one(block: Column, begin: Column) -> Column:
        end = F.greatest(begin, reach(block))

        def add(piece: Column) -> Column:
            def step(state: Column, span: Column) -> Column:
                gap = F.substring(piece, state["at"] - begin + 1, span["start"] - state["at"])
                inside = F.substring(piece, span["start"] - begin + 1, span["end"] - span["start"])
                behind = F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], gap, mark(inside, span)).alias("out"))
                return F.when(span["start"] < state["at"], F.struct(behind["at"].alias("at"), state["out"].alias("out"))).otherwise(behind)

            return F.aggregate(block, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda state: state["out"])

        return _let(F.substring(text, begin + 1, end - begin), add)

    def joined(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda out, block: F.concat(out, F.array(F.greatest(F.element_at(out, -1), reach(block)))))
        together = lambda at: F.concat(F.array_join(F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), one), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))
        return _let(begins, together)

    def whole(spans: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(spans))).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int"))
        return F.when(F.size(spans) == 0, text).otherwise(_let(F.transform(numbers, lambda k: F.slice(spans, k * size + 1, size)), joined))

    return _let(found, whole)


def redact(text: Column, spans: Column) -> Column:
    """The text with a mark, such as [EMAIL], in the place of each span; spans that overlap share the first one's.

    A removed term becomes [TERM], a generalised one its class, such as [qui*].
    """
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in ("email", "ip", "card", "phone", "term")))
    coarse = lambda inside: F.concat(F.lit("["), _class(F.lower(inside)), F.lit("]"))
    return _replaced(text, spans, lambda inside, span: F.when(span["kind"] == KINDS.index("generalised_term"), coarse(inside)).otherwise(F.get(marks, span["kind"])))


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same rows and columns, with all spans of ``text_col`` replaced by marks; texts without spans stay as they are.

    Null and empty texts stay null and empty; repeated rows stay repeated, and get equal texts. Very
    long texts as in :func:`find_pii`. An empty table stays empty, and columns with clashing names come
    back as they were.
    """
    place, names = docs.columns.index(text_col), docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    text = F.col(f"__c{place}")
    spans = find_pii(docs, id_col, text_col).where(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("__spans"))
    spans = _sized(stored(spans, "spans"))
    joined = plain.withColumn("__digest", F.md5(text.cast("binary"))).join(spans, F.col("__digest") == F.col("digest"), "left")
    clean = F.when(F.col("__spans").isNotNull(), redact(text, F.col("__spans"))).otherwise(text)
    return joined.select(*[(clean if i == place else F.col(f"__c{i}")).alias(f"__c{i}") for i in range(len(names))]).toDF(*names)
