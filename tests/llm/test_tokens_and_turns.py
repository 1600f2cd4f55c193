"""SentencePiece, alignment and conversation repair against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyforge.llm import alignment, conversations, pieces, queries
from keyforge.llm.common import table

SF = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b ", "x\ny", "a▁b", "▁", "é", "\U0001F600͸", "a\0b", "<s></s><0x0A><|endoftext|>", "﻿x", "日本語 の テスト",
       "x" * 1000, "ab " * 3000, "aé" * 900, " " * 700, "a\u0085 d \x1c e\x1c f  g", "don't 's  'll", "\n\n  two\n\n three \n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(PIECES))


@pytest.fixture(scope="module")
def byte_library():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.read_byte_level(BYTES), pieces.read_model(PIECES))


def sha(b) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def same_pieces(model, library, texts):
    ids, n = model.encode(pa.array(texts, pa.string()))
    at = 0
    for text, k, decoded in zip(texts, n, model.decode(ids, n), strict=True):
        want = library.encode(text or "")
        assert ids[at:at + k].tolist() == want
        assert decoded == library.decode(want)
        at += k


def test_pieces_of_odd_texts(model, library):
    same_pieces(model, library, [None, *ODD])
    rnd = random.Random(1)
    same_pieces(model, library, ["".join(rnd.choice("aeth ") for _ in range(rnd.randint(300, 1500))) for _ in range(60)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n▁aet.'"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_pieces_of_any_text(texts):
    same_pieces(_cached()[0], _cached()[1], texts)


_KEPT: list = []


def _cached():
    if not _KEPT:
        _KEPT.extend([pieces.PieceModel(pieces.read_model(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES)])
    return _KEPT


def test_any_ids_decode_as_the_library_does(model, library):
    rnd = random.Random(2)
    for _ in range(2000):
        ids = [rnd.choice([0, 1, 2, 259, rnd.randint(3, 258), rnd.randint(259, 31999)]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(np.array(ids, dtype=np.int64), np.array([len(ids)])) == [library.decode(ids)]


def test_models_that_cross_marks_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.pieces[31999].piece = "of▁the"
    path = tmp_path / "crossing.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="crosses"):
        pieces.read_model(str(path))


def test_piece_query_against_the_library(spark, library):
    rows = {r.doc_id: r for r in queries.op11_sentencepiece(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_piece_columns_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7)], "doc_id int, text string, n_tokens int")
    got = pieces.encode(df, PIECES, decoded_col="text").orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.text) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 2, "a b"), (3, 2, "a b")]
    back = pieces.decode(pieces.encode(df, PIECES), PIECES, out_col="text")
    assert sorted(r.text for r in back.collect()) == ["", "", "a b", "a b"]
    assert pieces.encode(df.limit(0), PIECES).count() == 0


# --- alignment ---


def piece_bytes(library, i):
    p = library.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()


def plain_groups(aligner, library, byte_library, text):
    """Groups of both tokenizers' ids, or None for a text without tokens."""
    if not text:
        return None
    a, b = byte_library.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
    bytes_a, bytes_b = [aligner.a.bytes[i].as_py() for i in a], [piece_bytes(library, i) for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    end_a, end_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    groups, i, j = [], 0, 0
    for end in sorted(set(end_a.tolist()) & set(end_b.tolist())):
        k, m = np.searchsorted(end_a, end) + 1, np.searchsorted(end_b, end) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def groups_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def fragments_of(aligner, text, size):
    cut = alignment.byte_ranges(text, size)
    return aligner.fragments(pa.array([c[2] for c in cut]), np.array([c[0] for c in cut]), np.array([c[1] for c in cut]))


@pytest.mark.parametrize("size", [5, 13, 64, 1 << 20])
def test_fragments_compose_to_the_whole(aligner, library, byte_library, size):
    rnd = random.Random(size)
    texts = [t for t in ODD if t and len(t) < 800 and (size > 5 or len(t) < 100)]
    texts += ["".join(rnd.choice("aeth éß.\n'▁ 日") for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    several = 0
    for text in texts:
        f = fragments_of(aligner, text, size)
        n = len(f.n_a)
        several += n > 2
        whole = alignment.compose(f, np.zeros(n, dtype=np.int64))
        cut = rnd.randint(1, n - 1) if n > 1 else 1
        two = alignment.compose(f, (np.arange(n) >= cut).astype(np.int64))
        again = alignment.compose(two, np.zeros(len(two.n_a), dtype=np.int64))
        assert all((getattr(whole, c) == getattr(again, c)).all() for c in ("a", "b", "cut_a", "cut_b", "n_a", "n_b", "n_cut", "same"))
        want = plain_groups(aligner, library, byte_library, text)
        assert bool(whole.same[0]) == (want is not None)
        if want is not None:
            assert aligner.groups_text(whole)[0].decode() == groups_text(want)
            links = Counter((x, y) for a, b in want for x in a for y in b)
            owner, pair, times = aligner.links(whole)
            assert {(int(p) // 32000, int(p) % 32000): int(n) for p, n in zip(pair, times, strict=True)} == dict(links)
    assert size > 100 or several > 20


def test_ranges_leave_fragments_open_at_both_ends(aligner):
    front, back = set(), set()
    for size in range(9, 40):
        f = fragments_of(aligner, "internationalisation of extraordinarily unquestionable misunderstandings " * 4, size)
        first, last = np.cumsum(f.n_cut) - f.n_cut, np.cumsum(f.n_cut) - 1
        front |= {int(f.cut_b[k]) for k, n in zip(first, f.n_cut, strict=True) if n}
        back |= {int(n_b - f.cut_b[k]) for k, n, n_b in zip(last, f.n_cut, f.n_b, strict=True) if n}
    assert max(front) > 1 and max(back) >= 1


def plain_alignment(aligner, library, byte_library, docs):
    groups = {k: plain_groups(aligner, library, byte_library, t) for k, t in enumerate(t for _, t in docs)}
    held, links = Counter(), {}
    for k, g in groups.items():
        links[k] = Counter((x, y) for a, b in g or [] for x in a for y in b)
        held.update(links[k].keys())
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for k, (doc_id, _) in enumerate(docs):
        g, c = groups[k] or [], links[k]
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()), sha(groups_text(g)) if g else ""))
    return sorted(out, key=str)


def test_alignment_query_against_plain_python(spark, aligner, library, byte_library):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_token_alignment(spark, SF).collect()]
    assert sorted(got, key=str) == plain_alignment(aligner, library, byte_library, docs)


def test_alignment_of_long_odd_and_repeated_texts(spark, aligner, library, byte_library):
    rnd = random.Random(3)
    docs = list(enumerate([None, *ODD]))
    docs += [(100 + k, "".join(rnd.choice("aeth é.\n") for _ in range(rnd.randint(1, 3000)))) for k in range(25)]
    docs += [(200, "one two"), (200, "one two"), (201, "long words here " * 2000), (201, "long words here " * 2000)]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in docs], "doc_id int, text string, row string, k int").repartition(3)
    got = alignment.align(df, BYTES, PIECES, range_bytes=64)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_alignment(aligner, library, byte_library, docs)
    assert alignment.align(df.limit(0), BYTES, PIECES).count() == 0


# --- conversations ---

ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Cost, audit and lines of the best edits, by trying all edits in order of cost and letters."""
    best = (4 * len(rows), "D" * len(rows), ())

    def go(k, out, cost, audit, inserts):
        nonlocal best
        if (cost, audit) > best[:2] and cost >= best[0] and (cost > best[0] or len(audit) > len(rows) + 8):
            return
        initials = "".join(x[:1] for x in out)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, out))
        due = "a" if initials.endswith("u") else "u"
        if inserts < 3:
            go(k, (*out, ROLES[due] + ":"), cost + 3, audit + "I", inserts + 1)
        if k < len(rows):
            role, text, must_go, cut = rows[k]
            more = 3 if cut else 0
            go(k + 1, out, cost + 4, audit + "D", 0)
            if not must_go:
                if role[:1] == due or role[:1] == "s" and not out:
                    go(k + 1, (*out, f"{role}:{text}"), cost + more, audit + "K", 0)
                go(k + 1, (*out, f"{ROLES[due]}:{text}"), cost + 3 + more, audit + "R", 0)

    go(0, (), 0, "", 0)
    return best


def plain_program(rows):
    """The same by a table over rows that holds whole strings."""
    ways = {0: (0, "", ())}
    for k in range(len(rows) + 1):
        spread = {}
        for s, (cost, audit, out) in ways.items():
            for n in range(3):
                spread.setdefault(s, []).append((cost, audit, out))
                due = "assistant" if s == 2 else "user"
                cost, audit, out, s = cost + 3, audit + "I", (*out, due + ":"), 3 if s == 2 else 2
        if k == len(rows):
            return min(min(spread.get(0, [(10 ** 9,)])), min(spread.get(3, [(10 ** 9,)])))
        role, text, must_go, cut = rows[k]
        ways, found = {}, []
        for s, options in spread.items():
            due, to = ("assistant", 3) if s == 2 else ("user", 2)
            more = 3 if cut else 0
            for cost, audit, out in options:
                found.append((s, (cost + 4, audit + "D", out)))
                if not must_go:
                    found.append((to, (cost + 3 + more, audit + "R", (*out, f"{due}:{text}"))))
                    if role[:1] == due[0] or role[:1] == "s" and s == 0:
                        found.append((1 if role[:1] == "s" else to, (cost + more, audit + "K", (*out, f"{role}:{text}"))))
        for s, way in found:
            ways[s] = min(ways.get(s, way), way)


def test_program_against_enumeration():
    rnd = random.Random(4)
    for _ in range(1500):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", " ", ""]), f"t{k}", rnd.random() < .15, rnd.random() < .2) for k in range(rnd.randint(0, 5))]
        p = conversations.Repair()
        for r in rows:
            p.row(*r)
        cost, audit, out = cheapest(rows)
        assert p.audit() == (cost, audit, sha("\n".join(out)))
        assert plain_program(rows) == (cost, audit, out)


def test_pointers_spill_for_giant_conversations(monkeypatch):
    monkeypatch.setattr(conversations, "SPILL_BYTES", 1000)
    rnd = random.Random(5)
    rows = [(rnd.choice(["user", "assistant"]), f"t{k}", rnd.random() < .1, rnd.random() < .2) for k in range(1500)]
    p = conversations.Repair()
    for r in rows:
        p.row(*r)
    assert p.pointers._rolled
    cost, audit, out = plain_program(rows)
    assert p.audit() == (cost, audit, sha("\n".join(out)))


def plain_repair(rows):
    """Every result column from raw ``(conv_id, turn, role, text)`` rows."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        harm = zlib.crc32(name.encode()) % 20
        own = convs[conv_id]
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        own += [(turn is not None, turn or 0, role.encode(), text.encode())] * (2 if harm == 3 else 1)
    out = []
    for conv_id, own in convs.items():
        own.sort()
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marked, n = set(), [], Counter()
        for _, _, role, text in own:
            role, text = role.decode(), text.decode()
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(marked, marked[1:], strict=False))
        cost, audit, lines = plain_program(marked)
        out.append((conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def test_repair_query_against_plain_python(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_repair(rows)


def odd_conversations():
    rnd = random.Random(6)
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 5, "system", "s."), (3, 0, "user", " \n\t")]
    texts = ["Yes.", "No?", "cut", "", None, " ", "a ", "Yes. \n", "x" * 5000, "d. e! f?"]
    for c in range(10, 60):
        rows += [(c, rnd.choice([None, *range(6)]), rnd.choice(["user", "assistant", "system", "tool", None, ""]), rnd.choice(texts)) for _ in range(rnd.randint(1, 8))]
    rows += [(99, k, ("user", "assistant")[k % 2], "same." if k % 3 == 0 else f"t{k}.") for k in range(700)]
    return rows


def test_repair_of_nulls_ties_repeats_and_one_giant(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seen string, copy int").repartition(4)
    got = conversations.repair(conversations.damaged(df)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_repair(rows)
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0


def test_repaired_rows_make_the_digest(spark):
    df = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    hurt = conversations.damaged(df)
    lines = defaultdict(list)
    for r in conversations.repaired_rows(hurt).orderBy("conv_id", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in conversations.repair(hurt).collect():
        assert sha("\n".join(lines[r.conv_id])) == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[r.conv_id]))


def test_repair_takes_rows_that_are_not_damaged(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string") \
        .withColumns({"dropped": F.lit(False), "copy": F.lit(0)})
    assert conversations.repair(df).first().audit == "KI"


def test_repair_statement_on_odd_rows():
    import duckdb
    import pandas as pd

    from keyforge.llm.oracles import ORACLE

    rows = [r for r in odd_conversations() if r[0] != 99]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    assert sorted(con.execute(ORACLE["op13_conversation_repair"]).fetchall(), key=str) == plain_repair(rows)
