from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from lodeflow.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(PLAIN).index(x[0])))


ODD = [
    "", None, "a@b.c", "a@b.c_d@e.f", "x@y.com%z@w.org", "@a.b", "a@b", "a@b..c", "😀 é@b.co x.y-z@mail-1.example.com.", "a@b.c@d.e", "..@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.03.255", "1.2.3", "99999999999999999999.1.1.1", "1.2.3.0000000000000000000000256",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "x4111111111111111y", "41 1111111111 11-11 ", "- 4111 1111 1111 1111 -", "4111 1111 1111 1112", "0" * 14, "0" * 20, "1 " * 30, "12 - 4111111111111111",
    "+1 (974) 555-3436", "++1 974 555 3436 ", "+1 (974) 555-3436 +44 20 7946 0958.", "+12345678901234567", "+1 -", "+1-----------------", "a" * 100_000 + "@b", "1 " * 20_000 + "x", "9" * 50_000, "+" * 10_000 + "1", "1.1." * 10_000,
]


def test_base_equals_the_plain_patterns(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.report(df).collect():
        want = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (texts[r.doc_id] or "")[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers_and_redaction(spark):
    rows = [(i, f"call host 10.0.{i}.7 now") for i in range(40)] + [(100, "see host 10.0.300.7 now"), (101, "version 2.0.1.999 here"), (102, "plain words"), (102, "host 10.9.999.9 other"), (102, "host 10.9.999.9 other"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hash int")
    got = [(r.doc_id, r.spans) for r in pii.report(df).collect()]
    assert len(got) == len(rows)
    assert dict(got)[100] == "ip:9:19" and dict(got)[101] == "" and sorted(s for i, s in got if i == 102) == ["", "ip:5:15", "ip:5:15"]
    text = sorted((r.doc_id or -1, r.text, r.hash) for r in pii.redacted(df).where("text is not null").collect())
    assert (100, "see host <IP> now", 1) in text and (102, "plain words", 1) in text and text.count((102, "host <IP> other", 1)) == 2 and len(text) == len(rows) - 1
    assert pii.report(df.limit(0)).count() == 0


def test_overlapping_spans_are_redacted_once(spark):
    df = spark.createDataFrame([(1, "a +1 (974) 555-3436 b x.1@y.com +4111111111111111 end")], "doc_id long, text string")
    assert pii.redacted(df).first().text in ("a <PHONE> b <EMAIL> +<CARD> end", "a <PHONE> b <EMAIL> <PHONE> end")


def added(rows):
    """Spans that the method adds, by its definition, in plain Python."""
    c = r"\p{L}0-9@._%+/=-"
    token = regex.compile(rf"(?<![{c}])(?=[\p{{L}}._%+/=-]*+[0-9@])[{c}]++")
    said = []
    for i, text in rows:
        base, last = brute(text), None
        for m in token.finditer(text):
            value = m[0].rstrip("._%+/=-")
            before = re.search(r"(\S*)\s*\Z", (last[0] if last else "") + text[last.end() if last else 0 : m.start()], re.A)
            kind = next((k for k, name in enumerate(pii.KINDS) if any(b[0] == name and b[1] < m.start() + len(value) and b[2] > m.start() for b in base)), None)
            shape = regex.sub(r"\p{L}+", "a", re.sub("[0-9]+", "0", value))
            said.append((i, m.start(), m.start() + len(value), (re.sub("[0-9]+", "0", before[1].lower()), shape), value.lower(), kind))
            last = m
    edges = defaultdict(lambda: [0] * 5)
    for _, _, _, pattern, value, kind in said:
        edges[pattern, value][0] += 1
        if kind is not None:
            edges[pattern, value][kind + 1] += 1
    own = defaultdict(lambda: [0] * 5)
    for (_, value), n in edges.items():
        own[value] = [a + b for a, b in zip(own[value], n)]
    score = {v: [x / n[0] for x in n[1:]] for v, n in own.items()}
    for _ in range(3):
        pattern, support, total = defaultdict(lambda: [0.0] * 4), Counter(), Counter()
        for (p, v), n in edges.items():
            pattern[p] = [a + n[0] * s for a, s in zip(pattern[p], score[v])]
            support[p] += sum(n[1:]) > 0
            total[p] += n[0]
        pattern = {p: [x / (total[p] + 1) for x in xs] for p, xs in pattern.items()}
        for v, n in own.items():
            if not sum(n[1:]):
                mine = [(p, m[0]) for (p, w), m in edges.items() if w == v]
                score[v] = [sum(k * pattern[p][j] for p, k in mine) / n[0] for j in range(4)]
    out = defaultdict(set)
    for i, a, b, p, v, kind in said:
        if kind is None and support[p] >= 5:
            out[i] |= {f"{pii.KINDS[k]}:{a}:{b}" for k in range(4) if pattern[p][k] >= 0.9 and score[v][k] >= 0.9}
    return out


def test_added_spans_equal_the_definition(spark):
    rng = random.Random(1)
    rows = [(i, f"{rng.choice(['call host', 'see', 'IP:', 'x'])} 10.0.{i}.{rng.choice([7, 7, 7, 300])} then +49 30 {1000000 + i} and mail b{i}@x{rng.choice(['.org', '.org', ''])} end 4{i}") for i in range(300)]
    rows += [(1000 + i, f"call {'x' * 60 if i % 2 else 'y' * 90} 10.0.{i}.7 now") for i in range(40)] + [(1100, "see " + "y" * 90 + " " * 100 + "10.0.300.7 now"), (1101, "see " + "y" * 91 + " 10.0.300.8 now")]
    want, hits = added(rows), 0
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.9).collect():
        base = {f"{k}:{a}:{b}" for k, a, b in brute(dict(rows)[r.doc_id])}
        assert set(filter(None, r.spans.split(","))) == base | want[r.doc_id], rows[r.doc_id]
        hits += len(want[r.doc_id])
    assert hits > 5 and want[1100] == {"ip:194:204"} and not want[1101]


def test_redaction_of_many_and_overlapping_spans_and_helper_names(spark):
    many = " ".join(f"é😀 10.0.{i % 250}.7 +1 (974) 555-{1000 + i % 9000}" for i in range(1500))
    names = ["id", "hash", "spans", "key", "more", "every", "text_hash", "_key"]
    df = spark.createDataFrame([(1, many, *range(8)), (2, None, *range(8))], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert got[1].text == " ".join(["é😀 <IP> <PHONE>"] * 1500) and got[2].text is None
    assert all([r[n] for n in names] == list(range(8)) for r in got.values()) and pii.redacted(df).columns == df.columns
