"""Line dedup against a plain one-process version and SQL."""

import random
import re

import odd
from compare import connect, same
from quire.llm import linededup, queries


def plain(docs, sentence_words):
    """{(doc_id, text): (what stays, spans)} by the definition, unit by unit."""
    seen, lines_seen, out = set(), set(), {}
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0], d[1])):
        units, at = [], 0
        old = set()
        for k, line in enumerate(text.split("\n")):
            if norm := " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), line).split()):
                old |= {k} if norm in lines_seen else set()
                lines_seen.add(norm)
            for piece in re.findall(r".*?[.!?]+[\"')\]]*(?:[ \t\r\v\f]+|$)|.+", line):
                norm = " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), piece).split())
                again = bool(norm) and norm in seen
                if norm:
                    seen.add(norm)
                units.append([k, at, at + len(piece), piece, len(norm.split()), again, False])
                at += len(piece)
            at += 1
        worded = [u for u in units if u[4]]
        i = 0
        while i < len(worded):
            j = i
            while j < len(worded) and worded[j][5]:
                j += 1
            if sentence_words is not None and sum(u[4] for u in worded[i:j]) >= sentence_words:
                for u in worded[i:j]:
                    u[6] = True
            i = max(j, i + 1)
        for u in units:
            u[6] |= u[0] in old
        lines = []
        for k, _ in enumerate(text.split("\n")):
            own = [u for u in units if u[0] == k]
            if any(u[4] and not u[6] for u in own) or not any(u[6] for u in own):
                lines.append("".join(u[3] for u in own if not u[6]))
        out[doc_id, text] = ("\n".join(lines), [(u[1], u[2]) for u in units if u[6]])
    return out


def test_against_plain_version(spark):
    rng = random.Random(3)
    phrases = ["One two three.", "Four five six seven eight!", "nine ten", "Éleven twelve? ", "A b c d e f g h i j k l.", "", "  ", "x.y z. ", "(Said he.) ", "No end here"]
    docs = [(i, "\n".join(" ".join(rng.choice(phrases) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    for least in (None, 1, 5, 10):
        got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), least).collect()
        want = plain(docs, least)
        original = dict(docs)
        assert len(got) == len(docs)
        for r in got:
            text, spans = want[r["doc_id"], original[r["doc_id"]]]
            assert (r["text"], [(s["start"], s["end"]) for s in r["removed_spans"] or ()]) == (text, spans)


def test_passage_inside_a_line(spark):
    passage = "First of the shared sentences. Then comes another one that is shared. And a third one ends the passage."
    docs = [(i, f"{i} own start of line {i} and then {passage} Own end {i}.\nOther line {i}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    assert all(got[i] == f"{i} own start of line {i} and then First of the shared sentences. Own end {i}.\nOther line {i}" for i in range(1, 5))


def test_short_whole_lines(spark):
    """Repeated lines go whatever their length; short pieces inside a line stay."""
    docs = [
        (1, "All rights reserved.\nShe left. He stayed.\nYes. And some own words one"),
        (2, "all  rights RESERVED.\nOwn line two\nShe left. He stayed."),
        (3, "Own start three. All rights reserved.\nYes.\nOwn line two\n\nYes."),
        (4, "She left.\nHe stayed. Own end four"),
    ]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got[1]["text"] == docs[0][1] and got[1]["removed_spans"] is None
    assert got[2]["text"] == "Own line two"
    assert got[3]["text"] == "Own start three. All rights reserved.\nYes.\n"
    assert got[4]["text"] == docs[3][1]
    assert [docs[1][1][a:b] for a, b in got[2]["removed_spans"]] == ["all  rights RESERVED.", "She left. ", "He stayed."]


def test_units_in_one_pass():
    import time

    slow = re.compile(rb"[^\n]*?[.!?]+[\"')\]]*(?:[ \t\r\x0b\x0c]+|(?=\n)|\Z)|[^\n]+")
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice("ab.!?\"') \n\t") for _ in range(rng.randint(0, 14))).encode()
        assert linededup._UNIT.findall(text) == slow.findall(text)
    began = time.perf_counter()
    for piece in (b".", b".x", b"..x ", b'.")x', b". ", b"x"):
        linededup._UNIT.findall(piece * 1_000_000)
    assert time.perf_counter() - began < 30
    assert linededup.cut("." * 1_000_000 + "\nEnd.", {0}, 1)[0] == "End."


def test_odd_rows(spark):
    docs = odd.frame(spark)
    got = linededup.dedup_lines(docs)
    assert got.count() == len(odd.rows())
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(r["text"])
    texts = {r[0]: r[1] for r in odd.rows()}
    assert by[1] == {texts[1]} and by[4] == {None} and by[5] == {""} and by[6] == {texts[6]} and by[10] == {""}
    assert by[2] == {"", "same id, another text"}
    assert "" in by[None]
    clash = linededup.dedup_lines(odd.clashing(spark))
    assert sorted(clash.columns) == sorted(odd.clashing(spark).columns) and clash.count() == len(odd.rows())
    assert linededup.dedup_lines(odd.empty(spark)).count() == 0


def test_sql(spark, sf_dir):
    same(queries.op3_line_dedup(spark, sf_dir).toPandas(), connect(sf_dir).sql(queries.oracle_sql()["op3_line_dedup"]).df())
