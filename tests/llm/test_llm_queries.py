"""The queries on text and keys: against SQL, or against what plain Python makes of the whole tables."""

from __future__ import annotations

import itertools
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from lodestrand.llm import lookalike as L
from lodestrand.llm.bpe import VOCABULARY
from lodestrand.llm.queries import ORACLES, QUERIES
from lodestrand.llm.subtitles import Spoken

from oracle import DATA, compare, connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark):
    compare(connection(), spark, QUERIES[name], ORACLES[name])


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(VOCABULARY)
    public.encode_special_tokens = True
    return {d: public.encode(t, add_special_tokens=False).ids if t else [] for d, t in texts.items()}


def test_ids_are_the_public_librarys(spark, ids):
    got = {r["doc_id"]: list(r["ids"]) for r in QUERIES["p6_ids"](spark, DATA).collect()}
    assert got == ids


def test_containers_hold_every_token_once(spark, texts):
    sizes = {r["doc_id"]: len(r["ids"]) for r in QUERIES["p6_ids"](spark, DATA).collect()}
    used, pieces = defaultdict(int), defaultdict(list)
    for r in QUERIES["p7_containers"](spark, DATA).collect():
        used[r["container"]] += r["n_tokens"]
        pieces[r["doc_id"]].append((r["piece"], r["n_tokens"]))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == sizes
    assert all(sorted(p) == [(i, 2048 if i < len(p) - 1 else n - 2048 * (len(p) - 1)) for i in range(len(p))] for d, p in pieces.items() for n in [sizes[d]])
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    report = QUERIES["p7_fill"](spark, DATA).first()
    least = -(-sum(sizes.values()) // 2048)
    assert (report["containers"], report["tokens"], report["least_containers"]) == (len(used), sum(sizes.values()), least)
    assert len(used) <= least * 1.02 + 1


def test_pairs_are_those_of_one_form(spark):
    named = {(r["folder"], r["path"]) for r in pq.read_table(f"{DATA}/index_records.parquet", columns=["folder", "path"]).to_pylist()}
    named |= {(r["folder"], p) for r in pq.read_table(f"{DATA}/collisions.parquet").to_pylist() for p in r["paths"] or ()}
    named = {(f, p) for f, p in named if f is not None and p is not None}
    form = L.Transducer(L.compiled(L.published(spark)))
    groups = defaultdict(list)
    for f, p in named:
        groups[f, form(p)].append(p)
    want = sorted((f, *pair) for (f, _), ps in groups.items() for pair in itertools.combinations(sorted(ps, key=str.encode), 2))
    assert want and sorted(map(tuple, QUERIES["p4_found"](spark, DATA).collect())) == want
    links = {(r["folder"], r["path"]): r["n_links"] for r in QUERIES["p4_classes"](spark, DATA).collect()}
    assert links == {(f, p): len(groups[f, form(p)]) - 1 for f, p in named}


def test_sentences_cover_all_speech(spark, texts):
    """Ends lie within their text, in order, behind a letter or mark, and no spoken word follows the last one."""
    got = defaultdict(list)
    for r in QUERIES["p8_found"](spark, DATA).collect():
        got[r["doc_id"]].append(r["end_char"])
    seen = 0
    for d, t in texts.items():
        ends = sorted(got[d])
        assert len(set(ends)) == len(ends)
        if not t or not t.strip():
            assert not ends
            continue
        spoken = Spoken(t)
        words = any(c.isalnum() for c in spoken.text)
        assert bool(ends) == words and all(0 < e <= len(t) and not t[e - 1].isspace() for e in ends)
        seen += len(ends)
    assert seen > len(texts)
