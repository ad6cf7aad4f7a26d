"""Conversation repair against a search over all edits, and against its SQL."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from cladeframe.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")
END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
GOAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else x
        role, text, lot = say(role), say(text), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "" if END.search(text) else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def search(rows, found):
    """Least (cost, audit, repaired lines) over every way to edit, with up to two inserts in each gap."""

    @functools.cache
    def rest(k, done):
        best = []
        fits = any(GOAL.fullmatch(done + tail) for tail in ("", "a", "ua", "uaua"))
        if not fits:
            return None
        if k == len(rows) and GOAL.fullmatch(done):
            best.append((0, "", ()))
        if k < len(rows):
            _, _, role, text = rows[k]
            more, ways = 3 * (found[k] == "truncated"), [(4, "D", done, ())]
            if found[k] not in ("blank", "duplicate"):
                ways += [(more, "K", done + (role[:1] or "?"), (f"{role}:{text}",))]
                ways += [(more + 3, "R", done + r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
            for cost, op, now, lines in ways:
                if (tail := rest(k + 1, now)) is not None:
                    best.append((cost + tail[0], op + tail[1], lines + tail[2]))
        if done.count("I") < 2 * (k + 1) and len(done) < 3 * len(rows) + 2:
            for r in ("user", "assistant"):
                now = done + r[0]
                if GOAL.fullmatch(now) or GOAL.fullmatch(now + "a"):
                    if inserts.get((k, done), 0) < 2:
                        inserts[(k, now)] = inserts.get((k, done), 0) + 1
                        if (tail := rest(k, now)) is not None:
                            best.append((3 + tail[0], "I" + tail[1], (f"{r}:", *tail[2])))
        return min(best, default=None)

    inserts = {}
    return rest(0, "")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        found = faults(mine)
        cost, audit, lines = search(mine, found) if mine else (0, "", ())
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def talks(rng, n, longest=5):
    say = lambda: rng.choice(["So it is.", "So it is", "", " \n", "Why?", f"No {rng.randrange(9)}!", "a. ", None])
    roles = ("user", "assistant", "user", "assistant", "system", "tool", "", None)
    return [(c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), say()) for c in range(n) for t in range(rng.randrange(1, longest + 1))]


KIND = "conv_id long, turn int, role string, text string"


def result(spark, rows, folder, run=repair.op11_repair):
    spark.createDataFrame(rows, KIND).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return {r["conv_id"]: r.asDict() for r in run(spark, str(folder)).collect()}


def test_repair_against_all_edits(spark, tmp_path):
    rows = talks(random.Random(5), 150) + [(None, 0, "user", "Hm."), (None, None, None, None)]
    got = result(spark, rows, tmp_path)
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv, facts in want.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == facts, (conv, [r for r in rows if r[0] == conv])


def test_repair_against_sql(spark, tmp_path):
    rows = talks(random.Random(6), 60, 12) + [(10_000, t, rng_role, "Yes." * (t % 3)) for t, rng_role in enumerate(["user", "assistant"] * 60)]
    got = result(spark, rows, tmp_path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = duck.sql(repair.ORACLE)
    assert {r[found.columns.index("conv_id")]: dict(zip(found.columns, r, strict=True)) for r in found.fetchall()} == got


@pytest.mark.parametrize("segment", [1, 2, 7])
def test_segments_change_nothing(spark, segment):
    rows = repair.flagged(repair.damaged(repair.turns(spark.createDataFrame(talks(random.Random(7), 40, 20), KIND))))
    whole = {tuple(r) for r in repair.edits(rows).collect()}
    assert {tuple(r) for r in repair.edits(rows, segment).collect()} == whole
    assert any("I" in r[2] for r in whole) and any("R" in r[2] for r in whole)


def test_long_conversation(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    got = result(spark, rows, tmp_path)[1]
    mine = damage(rows)
    assert sum(c in "KRD" for c in got["audit"]) == len(mine)
    assert got["cost"] == sum({"K": 0, "R": 3, "D": 4, "I": 3}[c] for c in got["audit"]) + 3 * sum(
        f == "truncated" and op != "D" for f, op in zip(faults(mine), (c for c in got["audit"] if c != "I"), strict=True)
    )


def test_nothing_left(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = result(spark, [(conv, 0, "user", "Hm.")], tmp_path)[conv]
    assert (got["gaps"], got["cost"], got["audit"], got["repaired_sha256"]) == (0, 0, "", hashlib.sha256(b"").hexdigest())
