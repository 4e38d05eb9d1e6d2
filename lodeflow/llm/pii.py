r"""Personal data: patterns for e-mail, IP, card and phone, and a bootstrapped contextual extraction around them.

Everything is DataFrame and SQL functions. A kind's matches are read with their places from two views of a text, the matches
and the pieces between them. The patterns are written so that Java's matcher needs no backtracking beyond a word and no
recursion; each finds the same leftmost, non-overlapping matches as the plain form in its comment.

The method: tokens with a digit or an at sign, their shape and the word before them are the graph's edges. Base matches are
seeds. A lexical pattern (word before, shape) scores by its instances' scores, an instance by its patterns' scores, in turns;
both sides are aggregated before they are joined. Unmatched tokens in a high-confidence pattern, with a high score of their
own, become spans of the pattern's kind. Base spans stay as they are. The word before a token is the run of other characters
than white space that ends before it or before the white space in front of it, back to the token before at most; words and
shapes count whole, however long.

Work grows in proportion to a text: a kind's spans are laid out as one mark for each character, in which a token looks up its
own place, and a text is cut by places in an encoding of fixed width.

Defined cases: a null text is empty; rows that repeat get the same spans; rows of one id with other texts are told apart by a
hash of the text; a token that meets spans of several kinds counts for the first kind; very long texts are read whole; an empty
table gives no rows; other columns are ignored (or pass through ``redacted``, whatever their names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.common import free_name, stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a match starts where a run starts or the last match ended.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ once lone separators only are left between digits; shorter chains can't hold 14 digits
CARD = r"(?<![0-9 -])[0-9][0-9 -]{13,}+"
LONE = r"(?<![0-9])[ -]|[ -](?![0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_C = r"\p{L}0-9@._%+/=-"
TOKEN = rf"(?<![{_C}])(?=[\p{{L}}._%+/=-]*+[0-9@])[{_C}]++"
SPAN = "struct<start:int,end:int,kind:int,value:string>"


def _q(pattern: str) -> str:
    return "r'" + pattern + "'"


def _running(text: str, pattern: str, keep: str, item: str, kind: str) -> str:
    """SQL for ``item`` (of the type ``kind``) of each match that passes ``keep``.

    They see the match ``z.m``, the piece before it ``z.p``, the end of the match before ``z.l`` and the match's place ``a.at +
    length(z.p)``. Matches are taken in parts of 256, so that a text of many matches costs no square of their number.
    """
    cell, width = "struct<m:string,p:string,l:string>", 256
    return f"""transform(array(named_struct('m', regexp_extract_all({text}, {_q(pattern)}, 0), 'p', split({text}, {_q(pattern)}, -1))), b ->
      transform(array(transform(b.m, (m, i) -> named_struct('m', m, 'p', b.p[i], 'l', if(i = 0, '', b.m[i - 1])))), zs ->
        flatten(transform(
          aggregate(transform(sequence(0, greatest(size(zs) - 1, 0), {width}), i -> slice(zs, i + 1, {width})),
            named_struct('at', 0, 'x', cast(array() as array<struct<at:int,part:array<{cell}>>>)),
            (a, part) -> named_struct('at', a.at + aggregate(part, 0, (n, z) -> n + length(z.p) + length(z.m)), 'x', concat(a.x, array(named_struct('at', a.at, 'part', part)))),
            a -> a.x),
          q -> aggregate(q.part, named_struct('at', q.at, 'found', cast(array() as array<{kind}>)),
            (a, z) -> named_struct('at', a.at + length(z.p) + length(z.m), 'found', if({keep}, concat(a.found, array({item})), a.found)),
            a -> a.found))))[0])[0]"""


def _placed(text: str, pattern: str, keep: str, kind: int) -> str:
    """SQL for the spans of a pattern's matches that pass ``keep``."""
    return _running(text, pattern, keep, f"named_struct('start', a.at + length(z.p), 'end', a.at + length(z.p) + length(z.m), 'kind', {kind}, 'value', z.m)", SPAN)


_DIGITS = "length(regexp_replace(z.m, '[^0-9]', ''))"
_LUHN = """aggregate(transform(split(reverse(regexp_replace(z.m, '[^0-9]', '')), ''), (c, i) ->
  case when c = '' then 0 when i % 2 = 0 then cast(c as int) when cast(c as int) > 4 then 2 * cast(c as int) - 9 else 2 * cast(c as int) end), 0, (s, x) -> s + x) % 10 = 0"""


def base_spans(text: str) -> Column:
    """All base spans of a column as array<SPAN>, by start, then kind."""
    none = f"cast(array() as array<{SPAN}>)"
    ip = "forall(split(z.m, r'\\.'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(right(x, 3) as int), 0) <= 255 and (length(x) <= 3 or ltrim('0', x) = ltrim('0', right(x, 3))))"
    single = f"regexp_replace({text}, {_q(LONE)}, '_')"
    parts = [
        f"if(instr({text}, '@') > 0, {_placed(text, EMAIL, 'true', 0)}, {none})",
        f"if({text} rlike {_q(r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]')}, {_placed(text, IP, ip, 1)}, {none})",
        f"if({text} rlike {_q('[0-9][0-9 -]{12,}+')}, transform(array({single}), t -> {_placed('t', CARD, f'{_DIGITS} between 14 and 19 and {_LUHN}', 2)})[0], {none})",
        f"if(instr({text}, '+') > 0, {_placed(text, PHONE, f'{_DIGITS} between 10 and 15', 3)}, {none})",
    ]
    return F.expr(f"array_sort(concat({', '.join(parts)}), (x, y) -> case when x.start <> y.start then x.start - y.start else x.kind - y.kind end)")


def _marks(spans: str, kind: int) -> str:
    """SQL for one byte for each character up to the end of a kind's last span: 1 inside its spans, 0 elsewhere."""
    own = f"filter({spans}, s -> s.kind = {kind})"
    gap = "repeat('0', s.start - if(i = 0, 0, x[i - 1].end))"
    return f"if(exists({spans}, s -> s.kind = {kind}), transform(array({own}), x -> cast(array_join(transform(x, (s, i) -> concat({gap}, repeat('1', s.end - s.start))), '') as binary))[0], null)"


def tokens(text: str, spans: str) -> Column:
    """array<struct<start,end,left,shape,value,kind>> of the candidate tokens; kind is that of a base span they meet, else null."""
    before = r"regexp_extract(concat(z.l, z.p), r'(?<!\S)(\S++)\s*+\z', 1)"
    found = _running(text, TOKEN, "true", f"named_struct('start', a.at + length(z.p), 'left', {before}, 'value', rtrim('._%+/=-', z.m))", "struct<start:int,left:string,value:string>")
    left = "regexp_replace(lower(x.left), '[0-9]+', '0')"
    shape = r"regexp_replace(regexp_replace(x.value, '[0-9]+', '0'), r'\p{L}+', 'a')"
    met = lambda k: f"instr(cast(substring(c.m{k}, x.start + 1, length(x.value)) as string), '1') > 0"
    kind = f"case {' '.join(f'when {met(k)} then {k}' for k in range(len(KINDS)))} end"
    each = f"named_struct('start', x.start, 'end', x.start + length(x.value), 'left', {left}, 'shape', {shape}, 'value', xxhash64(lower(x.value)), 'kind', {kind})"
    marks = ", ".join(f"'m{k}', {_marks(spans, k)}" for k in range(len(KINDS)))
    return F.expr(f"if({text} rlike '[0-9@]', transform(array(named_struct({marks})), c -> transform({found}, x -> {each}))[0], null)")


def found_base(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, spans, tokens) of every row, written: the texts are read once."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", "text", base_spans("text").alias("spans"))
    return stored(t.select("doc_id", F.xxhash64("text").alias("hash"), F.transform("spans", lambda s: s.dropFields("value")).alias("spans"), tokens("text", "spans").alias("tokens")))


def discovered(found: DataFrame, *, turns: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """(id, text_hash, more): the spans that high-confidence patterns add, by doc_id and hash."""
    said = found.select("doc_id", "hash", F.explode("tokens").alias("t")).select("doc_id", "hash", "t.*")
    ks = range(len(KINDS))
    edges = stored(said.groupBy("left", "shape", "value").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"k{k}") for k in ks)))
    seeded = reduce(lambda a, b: a + b, (F.col(f"k{k}") for k in ks))
    own = edges.groupBy("value").agg(F.sum("n").alias("all"), F.sum(seeded).alias("seeds"), *(F.sum(f"k{k}").alias(f"o{k}") for k in ks))
    seeds = own.select("value", (F.col("seeds") > 0).alias("seed"), *((F.col(f"o{k}") / F.col("all")).alias(f"s{k}") for k in ks))
    instances = seeds.select("value", *(f"s{k}" for k in ks))
    for _ in range(turns):
        scored = edges.join(instances, "value").groupBy("left", "shape").agg(F.sum(F.when(seeded > 0, 1).otherwise(0)).alias("support"), *((F.sum(F.col("n") * F.col(f"s{k}")) / (F.sum("n") + 1)).alias(f"p{k}") for k in ks))
        patterns = stored(scored)
        by = edges.join(patterns, ["left", "shape"]).groupBy("value").agg(*((F.sum(F.col("n") * F.col(f"p{k}")) / F.sum("n")).alias(f"q{k}") for k in ks))
        instances = stored(seeds.join(by, "value").select("value", *(F.when(F.col("seed"), F.col(f"s{k}")).otherwise(F.col(f"q{k}")).alias(f"s{k}") for k in ks)))
    sure = patterns.where(F.col("support") >= support).select("left", "shape", F.explode(F.array(*(F.struct(F.lit(k).alias("as"), F.col(f"p{k}").alias("p")) for k in ks))).alias("x")).where(F.col("x.p") >= confidence).select("left", "shape", F.col("x.as").alias("as"))
    score = F.element_at(F.array(*(F.col(f"s{k}") for k in ks)), F.col("as") + 1)
    # the edges are decided first: tokens, which are many more, meet only those that became spans
    good = stored(edges.where(F.col("n") > seeded).join(sure, ["left", "shape"]).join(instances, "value").where(score >= confidence).select("left", "shape", "value", "as"))
    new = said.where("kind is null").join(good, ["left", "shape", "value"])
    return new.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("text_hash")).agg(F.collect_set(F.struct("start", "end", F.col("as").alias("kind"))).alias("more"))


def _named(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({', '.join(map(repr, KINDS))}), s.kind + 1), s.start, s.end)), ',')"


_BY_START = "(x, y) -> case when x.start <> y.start then x.start - y.start when x.kind <> y.kind then x.kind - y.kind else x.end - y.end end"


def _every(docs: DataFrame, options: dict) -> DataFrame:
    """(doc_id, hash, spans, every): the base spans and all spans of each row."""
    found = found_base(docs)
    more = discovered(found, **options)
    out = found.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    every = f"array_sort(concat(spans, coalesce(more, cast(array() as array<struct<start:int,end:int,kind:int>>))), {_BY_START})"
    return out.select("doc_id", "hash", "spans", F.expr(every).alias("every"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, a count for each kind and base_sha256 of the base spans, and all spans, for each row of (doc_id, text)."""
    return _every(docs, options).select(
        "doc_id", *(F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(F.expr(_named("spans")), 256).alias("base_sha256"), F.expr(_named("every")).alias("spans"),
    )


def _apart(spans: str) -> str:
    """SQL for sorted spans with those that overlap made one, of the first one's kind.

    The furthest end so far is carried on in parts of 256 spans; a span that starts at it or behind begins a new one, and ends
    where the furthest end before the next such span lies.
    """
    cell = "struct<start:int,kind:int,before:int>"
    begun = f"""transform(array({spans}), v -> flatten(transform(
      aggregate(transform(sequence(0, greatest(size(v) - 1, 0), 256), i -> slice(v, i + 1, 256)),
        named_struct('far', 0, 'x', cast(array() as array<struct<far:int,part:array<struct<start:int,end:int,kind:int>>>>)),
        (a, part) -> named_struct('far', greatest(a.far, array_max(part.end)), 'x', concat(a.x, array(named_struct('far', a.far, 'part', part)))), a -> a.x),
      q -> aggregate(q.part, named_struct('far', q.far, 'x', cast(array() as array<{cell}>)),
        (a, s) -> named_struct('far', greatest(a.far, s.end), 'x', if(s.start >= a.far, concat(a.x, array(named_struct('start', s.start, 'kind', s.kind, 'before', a.far))), a.x)), a -> a.x))))[0]"""
    return f"transform(array(named_struct('b', {begun}, 'last', array_max({spans}.end))), w -> transform(w.b, (s, i) -> named_struct('start', s.start, 'end', coalesce(get(w.b, i + 1).before, w.last), 'kind', s.kind)))[0]"


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals between angle brackets; spans that overlap are one."""
    id_, hash_, spans_, key = (free_name(docs.columns, c) for c in ("id", "hash", "spans", "key"))
    spans = _every(docs, options).where("size(every) > 0").groupBy(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)).agg(F.first("every").alias("every"))
    spans = spans.select(id_, hash_, F.expr(_apart("every")).alias(spans_))
    names = f"array({', '.join(repr(f'<{k.upper()}>') for k in KINDS)})"
    piece = "decode(substring(c.u, 4 * if(i = 0, 0, c.m[i - 1].end) + 1, 4 * (s.start - if(i = 0, 0, c.m[i - 1].end))), 'UTF-32')"
    cut = f"""transform(array(named_struct('u', encode(text, 'UTF-32'), 'm', `{spans_}`)), c -> concat(
      array_join(transform(c.m, (s, i) -> concat({piece}, element_at({names}, s.kind + 1))), ''), decode(substring(c.u, 4 * c.m[size(c.m) - 1].end + 1), 'UTF-32')))[0]"""
    own = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = own.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_)), "left")
    return out.select(*(F.expr(f"if(`{spans_}` is null, text, {cut})").alias("text") if c == "text" else F.col(c) for c in docs.columns))
