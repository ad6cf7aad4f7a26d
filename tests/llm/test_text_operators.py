"""Tokens, ids in files, substrings, quality, archives, chat, packing and exact dedup against brute force and round trips."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cladeframe.llm import bpe, chat, exact_dedup, packing, quality, simple8b, substring, warc
from cladeframe.llm import textkernels as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\n", "a", "é ß 漢 😀", "x" * 5000, "a\x0bb\x0cc\r\nd", "<|endoftext|> <|im_end|>", " x y", "'s 're '", "w " * 4000]


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(spark, tmp_path, texts, ids=None):
    rows = [(i, t, f"src{k % 3}", k) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return table(spark, tmp_path, "documents", rows, "doc_id long, text string, source string, `__key` long")


def prose(rng, n, vocabulary=300):
    return " ".join(f"{rng.choice('abcdé')}{rng.randrange(vocabulary)}" for _ in range(n))


# --- exact dedup ----------------------------------------------------------------------------------------------------


def test_exact_dedup(spark, tmp_path):
    texts = [*ODD, "same", "same", "same ", "", None]
    got = {r["doc_id"]: r for r in exact_dedup.op1_exact_dedup(spark, documents(spark, tmp_path, texts)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for t, members in groups.items():
        for i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(members), len(members), i == max(members))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_state_lasts_over_batches(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(70)], "doc_id long, text string").repartition(6)
    got = exact_dedup.decide(docs, max_bytes_per_trigger=1).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(63 + k, 10) for k in range(7)}


def test_exact_dedup_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (1, "c")], "doc_id long, text string")
    assert sorted(r["text"] for r in exact_dedup.drop_copies(docs).collect()) == ["a", "b", "c"]
    empty = exact_dedup.op1_exact_dedup(spark, documents(spark, tmp_path, []))
    assert empty.collect() == []


# --- tokens ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_codec_equals_the_library(library):
    own = bpe.Codec(bpe.default_vocabulary(), memo=500)
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "!", "<|endoftext|>", "<|", "1", "23", " ", "　", " ", "\t", "ß", "漢", "😀", ".", "\x1c", "\x85", "Z", "_", "᠎", "\r\n", "½", "́", "abcdefghijklmnop"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(80)] + ODD
        ids, offsets = own.encode(*tk.buffer(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            mine = ids[offsets[i] : offsets[i + 1]]
            assert mine.tolist() == library.encode(t or "", add_special_tokens=False).ids, t
            assert own.decode(mine).decode() == (t or "")


def test_decode_of_any_ids(library):
    own, rng = bpe.codec(bpe.default_vocabulary()), np.random.default_rng(0)
    for _ in range(200):
        ids = rng.integers(0, 50257, rng.integers(0, 12))
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_op6(spark, tmp_path, library):
    texts = [*ODD, prose(random.Random(2), 3000)]
    got = {r["doc_id"]: r for r in bpe.op6_bpe(spark, documents(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("shift", [0, 20, 40, 55, 63])
def test_simple8b_round_trip(shift):
    rng = np.random.default_rng(shift)
    for n in (0, 1, 2, 59, 60, 61, 1000, 3000):
        v = (rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) >> rng.integers(0, 64, n).astype(np.uint64) >> np.uint64(shift)
        words, offsets, escaped = simple8b.pack(v, 128)
        assert (simple8b.unpack(words, escaped) == v).all()
        assert len(offsets) == -(-n // 128)
        if n > 300:  # a block decodes on its own
            assert (simple8b.unpack(words[offsets[1] : offsets[2]], escaped) == v[128:256]).all()


def test_simple8b_packs_small_values():
    assert len(simple8b.pack(np.ones(6000, np.uint64), 6000)[0]) == 100


def test_op3(spark, tmp_path, library):
    texts = [*ODD, *(prose(random.Random(k), 200) for k in range(30))]
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(4).shuffle(ids)
    got = simple8b.op3_simple8b(spark, documents(spark, tmp_path, texts, ids)).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(sorted(zip(ids, texts)), got, strict=True):
        tokens = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(tokens))
        assert r["ids_crc32"] == zlib.crc32(np.array(tokens, "<u4").tobytes())
        start += len(tokens)


def test_op3_odd_ids(spark, tmp_path):
    got = simple8b.op3_simple8b(spark, documents(spark, tmp_path, ["b", "a", "a", None], [5, None, None, 5])).collect()
    assert sorted((r["doc_id"] is not None, r["n_tokens"]) for r in got) == [(False, 2), (False, 2), (True, 1), (True, 2)]
    assert sorted(r["start"] for r in got)[:2] == [0, 2]
    assert simple8b.op3_simple8b(spark, documents(spark, tmp_path / "none", [])).collect() == []


# --- substrings -----------------------------------------------------------------------------------------------------


def brute_substrings(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.defaultdict(list)
    for i, w in enumerate(words):
        for j in range(len(w) - k + 1):
            seen[tuple(w[j : j + k])].append((i, j))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i].update(range(j, j + k))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest()) for w, g in zip(words, gone, strict=True)]


def test_substrings_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (34, 35, 36, 70, 200)]
    texts = [prose(rng, rng.randrange(60)) + " " + rng.choice(shared) + "\t" + prose(rng, rng.randrange(60)) for _ in range(80)]
    texts += [shared[4]] * 3 + [" ".join(shared), "z " * 100, "q " * 35, "q " * 34, *ODD]
    got = {r["doc_id"]: r for r in substring.op4_substring(spark, documents(spark, tmp_path, texts)).collect()}
    want = brute_substrings(texts, 35)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) for i in range(len(texts))] == want


def test_substrings_between_flushes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "WINDOW", 35)
    rng = random.Random(6)
    passage = prose(rng, 50)
    docs = spark.createDataFrame([(i, prose(rng, 20) + " " + passage) for i in range(40)], "__key long, text string").repartition(8)
    got = substring.repeats(docs, window=9).collect()
    assert all(r["n_removed"] >= 50 for r in got) and len(got) == 40


def test_substrings_odd_ids(spark, tmp_path):
    t = prose(random.Random(8), 40)
    got = substring.op4_substring(spark, documents(spark, tmp_path, [t, t, "a b"], [None, None, 3])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 40), (-1, 40), (3, 0)]
    assert substring.op4_substring(spark, documents(spark, tmp_path / "none", [])).collect() == []


def test_without_repeats_keeps_other_texts(spark):
    t = prose(random.Random(8), 40)
    docs = spark.createDataFrame([(1, t + " end", 0, "x"), (2, t, 0, "y"), (3, "a  b", 4, "z")], "doc_id long, text string, n_chars long, key string")
    got = {r["doc_id"]: r for r in substring.without_repeats(docs).collect()}
    assert got[1]["text"] == "end" and got[1]["n_chars"] == 3 and got[2]["text"] == "" and got[3] == (3, "a  b", 4, "z")


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_base(spark, tmp_path):
    texts = [*ODD, "a b c a b c", "one\ntwo\none\n one\n\n\none", "# * | x# <>", prose(random.Random(1), 80), "k l m n " * 30]
    got = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, documents(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j + d for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(lines) - len(set(lines)), len(hit), failed)
        assert r["kept"] == (not failed)


def _frequent_rows():
    rng = random.Random(2)
    common = prose(rng, 60)
    rows = [(i, common + "\n" + prose(rng, 5), "h") for i in range(8)]  # depleted without the common line
    rows += [(100 + i, common.upper() + "\n" + prose(rng, 80), "h") for i in range(3)]  # enough of their own
    rows += [(200 + i, common + "\n" + prose(rng, 5), "other") for i in range(3)]  # not frequent there
    rows += [(300 + i, "x y\n" + prose(random.Random(7), 60), "h") for i in range(20)]  # copies
    return rows + [(400, common, None), (401, None, None)]


def test_quality_frequent_lines(spark):
    rows = _frequent_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs, line_documents=5).collect()}
    assert len(got) == len(rows)
    assert not any(got[i]["kept"] for i in (*range(8), *range(300, 320), 401))  # copies are documents too
    assert all(got[i]["kept"] for i in (100, 101, 102, 200, 201, 202, 400))
    assert got[101]["removed_words"] == 60 and got[300]["removed_lines"] == 2
    assert quality.judge(docs.limit(0)).collect() == []


def test_quality_copies_once(spark):
    rows = _frequent_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs, line_documents=5, copies_once=True).collect()}
    assert len(got) == len(rows)
    assert [got[i]["kept"] for i in range(8)] == [True] + [False] * 7  # the first keeps the line
    assert all(got[i]["kept"] for i in (100, 101, 102, 200, 201, 202, *range(300, 320), 400))
    assert quality.accepted(docs).columns == docs.columns


@pytest.mark.parametrize(("others", "copies"), [(0, False), (6000, False), (0, True)])
def test_quality_sixty_documents_at_any_host_size(spark, others, copies):
    """A line of 60 documents goes from all 60, whatever else the host holds and whether they are copies or not."""
    rng = random.Random(60)
    own = [prose(rng, 60, 9000) for _ in range(60)]
    rows = [(i, f"{own[0] if copies else own[i]}\nall rights reserved", "h") for i in range(60)]
    rows += [(1000 + i, f"only here {i}", "h") for i in range(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judge(docs).filter("doc_id < 60 AND removed_words >= 3").collect()
    assert len(got) == 60 and all(r["kept"] != copies for r in got)


def test_quality_takes_frequent_lines_out(spark):
    rng = random.Random(5)
    common = ["All rights  reserved \u00c9", "read\tmore here"]
    rows = []
    for i in range(60):
        text = prose(rng, 60) + f"\n{common[0]}\n\n {common[0].upper()}\n" + prose(rng, 9) + (f"\n{common[1]}" if i < 55 else "") + "\n"
        rows.append((i, text, "h", len(text)))
    rows += [(59, rows[59][1], "h", rows[59][3]), (59, rows[59][1], "other", rows[59][3]), (None, rows[58][1], "h", rows[58][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = quality.accepted(docs)
    assert got.schema == docs.schema
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    gone = {norm(c) for c in common}

    def want(i, text, host, n):  # the first text keeps the lines, and so does a host where they are rare
        out = text if i == 0 or host == "other" else "\n".join(x for x in text.split("\n") if norm(x) not in gone)
        return i, out, host, len(out)

    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted((want(*r) for r in rows), key=order)
    told = {r["doc_id"]: r for r in quality.judge(docs, copies_once=True).collect()}
    for r in got.filter("doc_id < 59").collect():
        t = told[r["doc_id"]]
        assert len(WORD.findall(r["text"])) == t["n_words"] - t["removed_words"]


@pytest.mark.parametrize(("size", "gone"), [(400, {"x51"}), (5150, {"x51", "x52"})])
def test_quality_production_limits_equal_the_sql(spark, tmp_path, size, gone):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(size)
    lines = {"x50": 50, "x51": 51} if size < 5000 else {"x50": 50, "x51": 51, "x52": 52}
    rows, at = [], 0
    filler = prose(rng, 55)
    texts = [f"{filler}\nown {i}" for i in range(size)]
    for line, n in lines.items():
        for i in range(at, at + n):
            texts[i] += f"\n{line}"
        at += n
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    d = table(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, d).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, kept, removed_lines, removed_words FROM ({quality.ORACLE})").fetchall()
    assert {(i, r["kept"], r["removed_lines"], r["removed_words"]) for i, r in got.items()} == set(want)
    # the filler is frequent at either size, so a text that has lost more than it has lost a planted line too
    assert {texts[i].split("\n")[-1] for i, r in got.items() if r["removed_lines"] > 1} == gone


# --- archives -------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big, nasty = "é" * 600, "x" * 990 + "\r\n\r\nWARC/1.1\r\n\r\n"
    pages = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", nasty), (9, "u", nasty), (None, "u", big)]
    got = warc.op7_warc(spark, table(spark, tmp_path, "pages", pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    for page, _, html in pages:
        body = (html or "").encode()
        assert (by[page]["payload_bytes"], by[page]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        original = max(same) if len(body) >= 1000 else page
        assert (by[page]["record_type"], by[page]["refers_to"]) == (("response", None) if page == original else ("revisit", original))


def test_warc_empty_table(spark, tmp_path):
    assert warc.op7_warc(spark, table(spark, tmp_path, "pages", [], "page_id long, url string, html string")).collect() == []


def test_warc_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "z" * 2000), (1, "u", "z" * 2000), (0, "u", "z" * 2000)]
    got = warc.op7_warc(spark, table(spark, tmp_path, "pages", rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


# --- chat -----------------------------------------------------------------------------------------------------------

TALK = ["", "a", "<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<\\\\|", "\\<|", "<|<|", "l1\nl2\n", "😀é", '{"a": "b"}', None]


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["user"], ["to\nol", "<|x", "assistant"], [None, "assistant"]])
        rows += [(c, k, r, rng.choice(TALK)) for k, r in enumerate(roles)]
    rows += [(99, None, "user", "x"), (99, 0, "assistant", "y" * 50_000), (None, 0, "user", "n")]
    d = table(spark, tmp_path, "conversations", rng.sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.op9_chat(spark, d).collect()}
    talks = collections.defaultdict(list)
    for c, k, r, t in rows + [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]:
        talks[c].append((-1 if k is None else k, r or "", t or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_layouts(spark):
    say = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        "shared": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt": {"response": "a", "prompt": "q"},
        "completion": {"prompt": "q", "completion": "a"},
        "instruction": {"instruction": "q", "output": "a"},
        "message-parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"text": "a", "type": "text"}, {"type": "text", "text": None}]}]},
        "prompt-parts": {"prompt": ["q", None, ""], "response": "a"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("none", '{"x": 1}'), ("null", None), ("bad", "{"), ("list", "[1]")]
    got = {r["name"]: r for r in chat.canonical(spark.createDataFrame(rows, "name string, record string")).collect()}
    for k in records:
        assert got[k]["layout"] == k and [t.asDict() for t in got[k]["turns"]] == say
    for k in ("none", "null", "bad", "list"):
        assert got[k]["layout"] is None and got[k]["turns"] == []


@pytest.mark.parametrize(
    "nested",
    [
        {"messages": [{"role": "user", "content": {"type": "text", "text": "hi"}}]},
        {"messages": [{"role": "user", "content": ["hi"]}]},
        {"messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "hi"}]}]},
        {"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}, {"type": "text", "text": "hi"}]}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": {"value": "hi"}}]}]},
        {"messages": [{"role": ["user"], "content": "hi"}]},
        {"prompt": [["a"], ["b"]], "response": "x"},
        {"prompt": [{"text": "a"}], "response": "x"},
        {"prompt": "a", "response": ["x"]},
        {"prompt: STRING, response": "x"},
    ],
)
def test_chat_nested_values_never_become_text(spark, nested):
    r = chat.canonical(spark.createDataFrame([(json.dumps(nested),)], "record string")).first()
    assert r["layout"] is None and r["turns"] == []


def test_chat_long_records_keep_their_layout(spark):
    long = 'say "a", {b}: [c]\n\u00e9 ' * 400_000
    rows = [(json.dumps({"prompt": long, "response": 5}),), (json.dumps({"prompt": long, "responses of all": "a"}),)]
    got = chat.canonical(spark.createDataFrame(rows, "record string")).collect()
    assert [r["layout"] for r in got] == ["prompt", None]
    assert [t["text"] for t in got[0]["turns"]] == [long, "5"]


def test_chat_mixed_records_have_no_layout(spark):
    first = {"role": "user", "content": "q"}
    mixed = [
        {"messages": [first, {"role": "assistant", "value": "a"}]},
        {"messages": [first, None]},
        {"messages": [first, "a"]},
        {"messages": []},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "content": "a"}]},
        {"prompt": {"text": "q"}, "response": "a"},
        {"prompt": "q", "response": {}},
    ]
    plain = [{"prompt": '{"text": "q"}', "response": "{}"}, {"messages": [first, {"role": "assistant", "content": '{"a": 1}'}]}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(mixed + plain)]
    got = {r["n"]: r for r in chat.canonical(spark.createDataFrame(rows, "n int, record string")).collect()}
    assert [(got[i]["layout"], got[i]["turns"]) for i in range(len(mixed))] == [(None, [])] * len(mixed)
    assert [got[len(mixed) + i]["layout"] for i in range(2)] == ["prompt", "messages"]
    assert [t["text"] for t in got[len(mixed)]["turns"]] == ['{"text": "q"}', "{}"]


# --- packing --------------------------------------------------------------------------------------------------------


def brute_pack(items, capacity):
    bins, where = [], {}
    for k, length, s, c in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(r, i) for i, (r, ss, cc) in enumerate(bins) if r >= length and s not in ss and c not in cc]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[i][0] -= length
        bins[i][1].add(s)
        bins[i][2].add(c)
        where[k] = i
    return where


@pytest.mark.parametrize("seed", range(40))
def test_packing_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    n, capacity = int(r.integers(1, 120)), int(r.integers(5, 130))
    items = pd.DataFrame({"key": np.arange(n), "length": r.integers(1, capacity, n), "source_hash": r.integers(0, r.integers(1, 90), n), "cluster": r.integers(0, r.integers(1, 99), n)})
    got = packing.pack_shard(items, capacity).set_index("key")["bin"].to_dict()
    assert got == brute_pack(list(items.itertuples(index=False, name=None)), capacity)


@pytest.mark.parametrize("seed", range(40))
def test_packing_tells_all_sources_apart(seed):
    r = np.random.default_rng(1000 + seed)
    n, capacity = 200, int(r.integers(5, 130))
    sources = r.integers(-(1 << 63), (1 << 63) - 1, int(r.integers(1, 150)))
    items = pd.DataFrame({"key": np.arange(n), "length": r.integers(1, capacity, n), "source_hash": r.choice(sources, n), "cluster": r.integers(0, r.integers(1, 199), n)})
    rank = {s: i for i, s in enumerate(sorted(set(items["source_hash"])))}
    bins, want = [], {}
    for k, length, s, c in sorted(items.itertuples(index=False, name=None), key=lambda x: (-x[1], x[0])):
        fits = [(room, i) for i, (room, ss, cc) in enumerate(bins) if room >= length and rank[s] not in ss and c not in cc]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[i][0] -= length
        bins[i][1].add(rank[s])
        bins[i][2].add(c)
        want[k] = i
    assert packing.pack_shard(items, capacity).set_index("key")["bin"].to_dict() == want


def test_packing_fills_a_bin_beyond_64_pieces():
    n = 200
    items = pd.DataFrame({"key": np.arange(n), "length": np.ones(n, int), "source_hash": np.arange(n) * 64, "cluster": np.arange(n) * 64})
    assert packing.pack_shard(items, n)["bin"].tolist() == [0] * n


def test_op8(spark, tmp_path):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([3, 50, 900, 2048, 5000])) for _ in range(40)] + ["dup x"] * 5 + ODD
    got = packing.op8_best_fit(spark, documents(spark, tmp_path, texts)).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["bin_id"]))
    room, held = collections.Counter(), collections.defaultdict(list)
    for i, t in enumerate(texts):
        n = len(WORD.findall(t or ""))
        at = 0
        for start, length, b in sorted(pieces[i]):
            assert start == at and length <= 2048
            at += length
            if length:
                room[b] += length
                held[b].append((i % 3, t))
        assert at == n and (n or pieces[i] == [(0, 0, None)])
    assert max(room.values()) <= 2048
    for b in held.values():
        assert len({s for s, _ in b}) == len(b) == len({t for _, t in b})


def test_all_oracles_are_sql():
    import __spark_entry__ as entry

    assert {name for name, sql in entry.oracle_sql().items() if not isinstance(sql, str)} == set()


def test_op8_empty_table(spark, tmp_path):
    assert packing.op8_best_fit(spark, documents(spark, tmp_path, [])).collect() == []


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    clean = [prose(rng, 120, 9000) for _ in range(30)]
    near = clean[0].split()
    near[60] = "edited"
    passage = prose(rng, 60, 9000)
    texts = clean + [clean[1]] * 3 + [" ".join(near), "too short", None, ""] + [prose(rng, 80, 9000) + " " + passage for _ in range(2)]
    rows = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), out.schema) if name != "best-fit packing" else out
    n = len(clean)
    assert set(seen["quality rules"]) == {i for i, t in enumerate(texts) if len((t or "").split()) >= 50}
    assert set(seen["exact dedup"]) == set(seen["quality rules"]) - {1, n, n + 1}
    assert set(seen["near dedup"]) == set(seen["exact dedup"]) - {n + 3}
    last = len(texts) - 1
    assert seen["substring dedup"][last]["text"].split() == texts[last].split()[:80]
    assert seen["substring dedup"][last]["n_chars"] == len(seen["substring dedup"][last]["text"])
    assert seen["substring dedup"][5]["text"] == texts[5]
    assert set(seen["best-fit packing"]) == set(seen["substring dedup"])
