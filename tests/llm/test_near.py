"""Near-duplicate operators against brute force over all pairs."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import components, differences, line_dedup, minhash_dedup, poisson, workspace


def union_find(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def word_bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if 0 < len(w) < 5:
        return collections.Counter([tuple(w)])
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_links(bags):
    out = []
    for a, b in itertools.combinations(range(len(bags)), 2):
        o = sum((bags[a] & bags[b]).values())
        if o and 10 * o >= 8 * (sum(bags[a].values()) + sum(bags[b].values()) - o):
            out.append((a, b))
    return out


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def cloud(rng, n, length, most):
    """Copies of one text with a few edits or many, so that similarities lie on both sides of the threshold."""
    base = words(rng, length)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(150):
        n = int(rng.integers(3, 60))
        e = rng.integers(0, 1 << 63, n).astype(np.uint64)
        wa = rng.integers(0, 9, n)
        wb = np.where(rng.random(n) < 0.8, wa, rng.integers(0, 9, n))
        wa[0] = wb[0] = 1
        bag = np.array([0] * (wa > 0).sum() + [1] * (wb > 0).sum())
        s = poisson.signatures(np.concatenate([e[wa > 0], e[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]), bag, 2, 64)
        errors.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.07


def test_signature_does_not_depend_on_the_batch():
    e, w = np.arange(1, 40).astype(np.uint64), np.ones(39, np.int64)
    alone = poisson.signatures(e[:20], w[:20], np.zeros(20, np.int64), 1)
    both = poisson.signatures(e, w, np.array([0] * 20 + [1] * 19), 2)
    assert (alone[0] == both[0]).all()


def run_near(spark, tmp_path, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return minhash_dedup.op5_minhash_dedup(spark, str(tmp_path)).collect()


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    texts = cloud(rng, 60, 150, 30) + cloud(rng, 30, 60, 9)
    texts += [passage + " " + " ".join(words(rng, 40)) for _ in range(40)]  # share a passage, not similar
    texts += [texts[0]] * 5 + ["a b c", "a b c", "a b", "", None, " \n", "x " * 300, "x " * 290, "x " * 200]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in run_near(spark, tmp_path, texts)}
    want = union_find(len(texts), brute_links([word_bag(t) for t in texts]))
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    size = collections.Counter(want)
    assert all(got[i]["class_size"] == size[want[i]] and got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_links_by_common_edits_equal_brute_force(spark, tmp_path):
    """Every edit is common to many texts, so that links run between texts that are not linked to any lead."""
    rng = random.Random(3)
    base, texts = words(rng, 150), []
    for _ in range(400):
        w = list(base)
        for i in rng.sample(range(40), rng.randrange(1, 9)):
            w[1 + i * 149 // 40] = f"e{i}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in run_near(spark, tmp_path, texts)}
    assert [got[i] for i in range(len(texts))] == union_find(len(texts), brute_links([word_bag(t) for t in texts]))


def code_words():
    """The extended binary Golay code: 4,096 words of 24 bits, any two of which differ in eight or more."""
    out = []
    for m in range(1 << 12):
        rest = m << 11
        for i in range(22, 10, -1):
            if rest >> i & 1:
                rest ^= 0b101011100011 << (i - 11)
        word = m << 11 | rest
        out.append(word << 1 | word.bit_count() % 2)
    return out


def test_texts_just_below_the_threshold_make_few_pairs(spark, tmp_path, monkeypatch):
    """Each text is its own class, all are 0.762 similar to many, and no edit is rare; pairs follow the texts, not their square."""
    rng = random.Random(0)
    base = words(rng, 300)
    pairs = []
    check = minhash_dedup.Verifier.check
    monkeypatch.setattr(minhash_dedup.Verifier, "check", lambda self, p: pairs.append(p.count()) or check(self, p))
    for n in (200, 800):
        texts = []
        for code in rng.sample(code_words(), n):
            w = list(base)
            for i in range(24):
                if code >> i & 1:
                    w[6 + 12 * i] = f"e{i}"
            texts.append(" ".join(w))
        got = run_near(spark, tmp_path / str(n), texts)
        assert len({r["class_id"] for r in got}) == n
    assert pairs[1] < 6 * pairs[0]


def kernels(bags, comps, buckets=16):
    """The steps of the kernels in this process: links between components of items that are not linked to the lead, item 0."""
    gather = differences.Gather(buckets)
    for i in range(1, len(bags)):
        gather.add(0, i, comps[i], differences.BETWEEN, bags[0], bags[i])
    rows = gather.flush()

    def dealt(some):
        return differences.blobs.batches(sorted(some, key=lambda r: r[:3]))

    def listed(stream):
        return [tuple(r.values()) for batch in stream for r in batch.to_pylist()]

    replies = listed(differences._counted(dealt([r for r in rows if r[1] == differences.ASKED])))
    sent = listed(differences._prefixes(buckets, dealt([r for r in rows if r[1] == differences.HELD] + replies)))
    return listed(differences._links(dealt(sent)))


def code_bags(rng, n):
    """Bags of texts of 300 words with edits by words of the code: 5 shingles for each edit."""
    out = [(np.arange(296, dtype=np.uint64), np.ones(296, np.int64))]
    for code in rng.sample(code_words(), n):
        e = np.arange(296, dtype=np.uint64)
        for i in range(24):
            if code >> i & 1:
                e[2 + 12 * i : 7 + 12 * i] += np.uint64(1000)
        out.append((np.sort(e), np.ones(296, np.int64)))
    return out


@pytest.mark.parametrize("shard", [differences.SHARD, 100])
def test_pairs_are_compared_once_and_few_at_all(monkeypatch, shard):
    """Of pairs just below the threshold, none is compared twice, though they share many elements and meet in many shards."""
    monkeypatch.setattr(differences, "SHARD", shard)
    compared, near = [], differences.Meetings.near

    def noted(self, x, y, *at):
        compared.extend(zip(np.minimum(self.ids[x], self.ids[y]).tolist(), np.maximum(self.ids[x], self.ids[y]).tolist(), strict=True))
        return near(self, x, y, *at)

    made = differences.Meetings.__init__
    monkeypatch.setattr(differences.Meetings, "__init__", lambda self, key, *rest: (setattr(self, "ids", key), made(self, key, *rest))[1])
    monkeypatch.setattr(differences.Meetings, "near", noted)
    for n in (250, 500, 1000):
        compared.clear()
        assert kernels(code_bags(random.Random(0), n), list(range(n + 1))) == []
        assert len(set(compared)) == len(compared)
        assert len(compared) < n * (n - 1) // 2
        print("compared", n, len(compared), n * (n - 1) // 2)


@pytest.mark.parametrize("shard", [differences.SHARD, 5])
def test_kernels_equal_brute_force(monkeypatch, shard):
    """Components of items whose edits are common, by lists cut to small shards too."""
    monkeypatch.setattr(differences, "SHARD", shard)
    for seed in range(6):
        rng = random.Random(seed)
        bags = [(np.arange(60, dtype=np.uint64), np.ones(60, np.int64))]
        while len(bags) < 80:
            e = np.arange(60, dtype=np.uint64)
            for i in rng.sample(range(30), rng.randrange(8, 14)):
                e[i] += np.uint64(1000)
            bags.append((np.sort(e), np.ones(60, np.int64)))
        count = [collections.Counter(b[0].tolist()) for b in bags]
        links = [x for x in brute_links(count) if x[0]]
        assert not any(x[0] == 0 for x in brute_links(count))
        want = union_find(len(bags), links)
        assert links and union_find(len(bags), kernels(bags, list(range(len(bags))))) == want


def test_lists_are_sent_once_to_their_group(monkeypatch):
    """What items of a group send to meet follows their lists, not the number of elements in each."""
    sent, links = [], differences._links
    monkeypatch.setattr(differences, "_links", lambda stream: links(sent.append(list(stream)) or sent[-1]))
    code = code_bags(random.Random(0), 1000)
    mb = {}
    for n in (250, 1000):
        sent.clear()
        assert kernels(code[: n + 1], list(range(n + 1)), buckets=64) == []
        mb[n] = sum(len(p.as_py()) for batch in sent[0] for p in batch.column("payload")) / 1e6
    lists = sum(len(differences.difference(code[0], b)) for b in code[1:]) // 5  # the five shingles of an edit are one
    assert mb[1000] < lists * 16 / 1e6
    assert mb[1000] < 5 * mb[250]


@pytest.mark.parametrize("shards", [1, 4, 30])
def test_groups_in_shards_equal_brute_force(monkeypatch, shards):
    """Items of two groups in the same buckets, each group cut to shards: no link is lost, and none between groups."""
    add = differences.Gather.add
    monkeypatch.setattr(differences.Gather, "add", lambda self, lead, key, *rest: add(self, key % 2, key, *rest, shards))
    for seed in range(3):
        rng = random.Random(seed)
        bags = [(np.arange(60, dtype=np.uint64), np.ones(60, np.int64))]
        while len(bags) < 120:
            e = np.arange(60, dtype=np.uint64)
            for i in rng.sample(range(30), rng.randrange(8, 14)):
                e[i] += np.uint64(1000)
            bags.append((np.sort(e), np.ones(60, np.int64)))
        links = [x for x in brute_links([collections.Counter(b[0].tolist()) for b in bags]) if x[0] and x[0] % 2 == x[1] % 2]
        assert links and union_find(len(bags), kernels(bags, list(range(len(bags))), buckets=4)) == union_find(len(bags), links)


def test_shuffle_files_go_with_their_job(spark):
    """A table written for a later step leaves no shuffle files, and the session's setting is as before."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    known = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    had = known()
    workspace.materialise(rows, "few")
    for _ in range(50):  # files are removed beside the job
        if known() <= had:
            break
        time.sleep(0.1)
    assert known() <= had
    assert spark.conf.get(setting, None) == before


@pytest.mark.parametrize("seed", range(3))
def test_differences_are_those_of_bags(seed):
    rng = np.random.default_rng(seed)
    bags = []
    for _ in range(3):
        e = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
        bags.append((e, rng.integers(1, 4, len(e))))
    count = lambda b: collections.Counter(dict(zip(b[0].tolist(), b[1].tolist(), strict=True)))
    a, b, c = (count(x) for x in bags)
    d1, d2 = (set(differences.difference(bags[0], x).tolist()) for x in bags[1:])
    assert len(d1) == sum(((a - b) + (b - a)).values())
    assert len(d1) + len(d2) - 2 * len(d1 & d2) == sum(((b - c) + (c - b)).values())


def test_near_duplicates_null_and_repeated_ids(spark, tmp_path):
    text = " ".join(words(random.Random(1), 30))
    got = run_near(spark, tmp_path, [text, text, text, "other words here in this one"], [None, 7, 7, None])
    assert sorted(r["class_size"] for r in got) == [1, 3, 3, 3]
    assert sum(r["kept"] for r in got) == 2


def test_near_duplicates_empty_table(spark, tmp_path):
    assert run_near(spark, tmp_path, []) == []


def test_drop_near_copies_keeps_columns(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(cloud(rng, 6, 80, 2))], "doc_id long, text string, key int, `__id` string")
    kept = minhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(500, [e for e in edges if e[0] != e[1]])
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(texts):
    lines = [(i, j, x) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for _, _, x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if sets[a] & sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = union_find(len(lines), links)
    gone = collections.defaultdict(list)
    for k, (i, j, _) in enumerate(lines):
        if root[k] != k:
            gone[i].append((j, *lines[root[k]][:2]))
    return gone


def test_line_dedup_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    short = cloud(rng, 12, 10, 2)
    long = cloud(rng, 12, 70, 6)  # both sides of the limit between the two kinds of signature
    mid = cloud(rng, 12, 34, 4)
    pool = short + long + mid + [" ".join(words(rng, 12)) for _ in range(20)] + ["ü" * 5, "ü" * 5, "tiny", "tiny", "  ", "", "\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + [None, "", "tiny\ntiny\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    gone = brute_lines(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        kept = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in {g[0] for g in gone[i]})
        assert [tuple(x) for x in got[i]["removed"]] == sorted(gone[i]), (i, t)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert got[i]["n_removed"] == len(gone[i])


def test_line_dedup_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert line_dedup.op2_line_dedup(spark, str(tmp_path)).collect() == []


def test_line_dedup_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "one line of text here\nsame"), (4, "one line of text here"), (4, "one line of text here"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in got) == [(0, 2, 0), (2, 1, 0), (4, 1, 1), (4, 1, 1)]
    assert {tuple(x) for r in got for x in r["removed"]} == {(0, None, 0)}


def test_line_dedup_very_long_line(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(words(rng, 60000))
    rows = [(1, long + "\nend"), (2, "x\n" + long + " more"), (3, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [(1, 1, 0)], 3: []}
