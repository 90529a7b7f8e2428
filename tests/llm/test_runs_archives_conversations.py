"""Periodic runs, page archives and conversation repair against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import os
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from quire.llm import conversations, periodic, warc
from quire.llm import queries as Q
from quire.llm.common import Scratch


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 11: periodic runs ---------------------------------------------------------------


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(q % r == 0 and part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic_texts(seed=4, n=150):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "ab ab ab ab", "a b a b a b a b", "x\x0by " * 9, "é 日 " * 40 + "end", "q " * 5000]
    for _ in range(n):
        kinds, w = rng.choice([1, 2, 3, 6]), []
        while len(w) < rng.randint(0, 150):
            part = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 9))]
            w += part * rng.randint(1, 8) + [f"z{rng.randrange(400)}"] * rng.randint(0, 1)
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts


def test_runs(spark):
    texts = periodic_texts()
    rows = [(i * 7, t, "x", 1) for i, t in enumerate(texts)] + [(7, "k l " * 6, "y", 2), (None, "m m m m m m m", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(4)
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.find_runs(docs).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        w = words_of(text)
        runs = brute_runs(w)
        want.add((doc_id, len(w), tuple(runs), " ".join(brute_collapse(w, runs))))
    assert got == want


def test_digests_of_planted_runs(spark):
    rows = [(i, " ".join(f"v{(i * j * j) % 89}" for j in range(i % 140))) for i in range(400)] + [(None, "a b"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in periodic.run_digests(periodic.find_runs(periodic.planted(docs))).drop("n_words").collect()}
    want = set()
    for doc_id, text in rows:
        w = words_of(text)
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.add((doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(brute_collapse(w, runs)))))
    assert got == want and sum(x[1] > 0 for x in want) > 15


def test_runs_of_long_texts():
    for w in (np.zeros(30_000, int), np.arange(30_000) % 3, np.random.default_rng(0).integers(0, 200, 30_000)):
        assert len(periodic.runs_of(w)) <= 1
    a = np.concatenate([np.arange(9000) % 2000, np.arange(5)])
    assert periodic.runs_of(a) == [(0, 9000, 2000)]


def test_splitting_keeps_every_run():
    rng = random.Random(9)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(6, 60))]
        for _ in range(2):
            at = rng.randrange(len(w))
            w[at:at] = [rng.randrange(30) for _ in range(rng.randint(1, 4))] * rng.randint(3, 6)
        a = np.array(w)
        segments = periodic.survivors(a, np.array([0, len(a)]), periodic.Periodic())
        found = [(s + lo, n, q) for lo, hi in segments for s, n, q in periodic.runs_of(a[lo:hi])]
        assert sorted(found, key=lambda x: (x[0], x[2])) == brute_runs(w)


def test_few_copies_are_refused():
    with pytest.raises(ValueError):
        periodic.Periodic(copies=3)


# --- 12: archives ---------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>x"), (2, None, "<p>x"), (3, "http://b\r\nWARC-Type: y", None), (4, "u", ""), (None, "u", "é" * 5000), (7, "u", "é" * 5000), (None, "q", "only"), (None, "q", "only")]
PAGES += [(9, "u", "dup"), (9, "u", "dup"), (8, "u", "dup"), (11, "u", "a\r\n\r\nb\r\n\r\n"), (12, "u", "z" * 300_000), (13, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n")]


def archive_rows():
    out = []
    for page_id, _, html in PAGES:
        body = html or ""
        ids = [i for i, _, h in PAGES if (h or "") == body and i is not None]
        again = len([h for *_, h in PAGES if (h or "") == body]) > 1 and bool(ids) and page_id != max(ids)
        digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        out.append((page_id, len(body.encode()), digest, "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def pages_of(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, record_type string, offset int").repartition(3)


def test_archives(spark):
    got = sorted((tuple(r[c] for c in NAMES) for r in warc.archive_pages(pages_of(spark)).collect()), key=repr)
    assert got == archive_rows()


def test_archives_match_sql(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    theirs = con.execute(f"select {', '.join(NAMES)} from ({Q.SQL['op12_warc_normaliser']})").fetchall()
    ours = [tuple(r[c] for c in NAMES) for r in Q.op12_warc_normaliser(spark, folder).collect()]
    assert sorted(ours) == sorted(theirs)


@pytest.mark.parametrize("records", [1, 3, 100])
def test_members_lie_where_the_index_says(spark, records):
    scratch, p = Scratch(spark, "warc-test"), warc.Warc(records=records, piece=50)
    warc.write_streams(warc.plan_records(pages_of(spark).coalesce(1), scratch, p), f"{scratch.root}/streams", p)
    index = warc.normalise(spark, f"{scratch.root}/streams", scratch.root, p).collect()
    files = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{scratch.root}/archives").collect()}
    streams = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{scratch.root}/streams").collect()]
    assert len(files) == len(streams) == -(-len(PAGES) // records)
    # Each archive says what its stream said, record by record, and ends with an empty member.
    assert sorted(map(gzip.decompress, files.values())) == sorted(map(gzip.decompress, streams))
    assert all(raw.endswith(warc.LAST_MEMBER) for raw in files.values())
    for r in index:
        whole = gzip.decompress(files[r["archive"]][r["offset"] : r["offset"] + r["length"]])
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and whole.endswith(warc.END)
        assert whole.count(b"\r\nWARC-Type:") == 1  # the url's line break made no header
    assert sum(r["length"] for r in index) + len(files) * len(warc.LAST_MEMBER) == sum(map(len, files.values()))


def test_fetch(spark):
    scratch = Scratch(spark, "warc-test")
    warc.write_streams(warc.plan_records(pages_of(spark), scratch), f"{scratch.root}/streams")
    warc.normalise(spark, f"{scratch.root}/streams", scratch.root)
    wanted = spark.createDataFrame([(1,), (2,), (3,), (8,), (12,), (13,), (999,)], "page_id long")
    got = {tuple(r) for r in warc.fetch(spark, scratch.root, wanted).collect()}
    assert got == {(i, h or "") for i, _, h in PAGES if i in (1, 2, 3, 8, 12, 13)}


def test_small_payloads_are_all_responses(spark):
    got = warc.archive_pages(pages_of(spark), warc.Warc(least_bytes=4)).where("payload_bytes < 4").collect()
    assert len(got) == 5 and all(r["record_type"] == "response" for r in got)


def test_broken_archives_are_refused():
    raw = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert [w for _, w in warc.split_records(warc._inflated(raw + raw, 7))] == [gzip.decompress(raw)] * 2
    with pytest.raises(ValueError):
        list(warc.split_records(warc._inflated(raw[:-9], 100)))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab"])))
    with pytest.raises(ValueError):
        warc.read_member(raw[:20])
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabx"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:A\r\nContent-Length: {len(block)}\r\n\r\n"
    with pytest.raises(ValueError, match="isn't what was written"):
        warc.facts(*next(warc.split_records(iter([head.encode() + block + warc.END]))))


# --- 13: conversations ------------------------------------------------------------------


def brute_edits(initials, faults):
    """Least (cost, audit) by plain pairs, with up to two insertions anywhere."""
    kept, given = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2)

    @lru_cache(None)
    def best(i, place, inserted):
        found = [(0, "")] if i == len(initials) and place in (0, 3) else []
        if inserted < 2:
            cost, rest = best(i, given[place], inserted + 1)
            found.append((cost + 5, "I" + rest))
        if i < len(initials):
            more = 5 if faults[i] == "3" else 0
            cost, rest = best(i + 1, place, 0)
            found.append((cost + 2, "D" + rest))
            if faults[i] in "03":
                cost, rest = best(i + 1, given[place], 0)
                found.append((cost + 1 + more, "R" + rest))
                if initials[i] in kept[place]:
                    cost, rest = best(i + 1, kept[place][initials[i]], 0)
                    found.append((cost + more, "K" + rest))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def brute_repair(everyone, rows):
    """rows: (conv_id, turn, role, text) after damage."""
    out = set()
    for conv in everyone:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = "", set()
        for _, role, text in own:
            bare = text.strip(" \t\n\r\x0b\x0c")
            faults += "1" if not bare else "2" if (role, text) in seen else "3" if bare[-1] not in ".!?" else "0"
            seen.add((role, text))
        initials = "".join(r[1][:1] or " " for r in own)
        cost, audit = brute_edits(initials, faults)
        place, said, i = 0, [], 0
        for letter in audit:
            given = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))[place]
            if letter == "I":
                said.append(given[1] + ":")
            else:
                _, role, text = own[i]
                i += 1
                if letter == "D":
                    continue
                if letter == "K":
                    given = ({"s": 1, "u": 2, "a": 3}[role[0]], role)
                said.append(given[1] + ":" + text)
            place = given[0]
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.add((conv, gaps, *(faults.count(f) for f in "123"), illegal, cost, audit, sha("\n".join(said))))
    return out


def chats(seed=8, n=60):
    rng = random.Random(seed)
    says = ["Hi.", "Why?", "no end", "", " ", None, "Done!  \n", "é.", "two. three", "ok."]
    rows = []
    for conv in [*range(n), None]:
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 5)
        for t, role in enumerate(roles):
            if rng.random() < 0.3:
                role = rng.choice(["user", "assistant", "system", "tool", None, "", "ü"])
            turn = rng.choice([t, t, t, t + 1, None])
            rows += [(conv, turn, role, rng.choice(says) if rng.random() < 0.6 else f"{t} {rng.random()}.")] * rng.choice([1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block,fan", [(512, 256), (3, 2), (1, 2), (7, 3)])
def test_repair(spark, block, fan):
    rows = chats()
    everyone = {r[0] for r in rows} | {777}
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", at long, audit string").repartition(3)
    ids = spark.createDataFrame([(c,) for c in everyone], "conv_id long")
    got = {tuple(r) for r in conversations.repair(table, conversations.Repair(block=block, fan=fan), ids).collect()}
    assert got == brute_repair(everyone, rows)


def test_one_long_conversation(spark):
    rng = random.Random(1)
    rows = [(5, i, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(90)}{rng.choice('.!?x')}") for i in range(250)] + [(6, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {tuple(r) for r in conversations.repair(table, conversations.Repair(block=5, fan=3)).collect()}
    assert got == brute_repair({5, 6}, rows)


def test_damage_and_repair(spark):
    rows = [(c, t, ["system", "user", "assistant"][t % 3], f"Text {c} {t}! More?") for c in range(80) for t in range(c % 7 + 1)] + [(None, None, None, None), (3, None, "user", "Yes.")]
    after = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            after += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    table = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in conversations.repair(conversations.damaged(table), everyone=table).collect()}
    assert got == brute_repair({r[0] for r in rows}, after)


def test_tables_join_in_any_order():
    rng = random.Random(5)
    for _ in range(200):
        parts = [("".join(rng.choice("sua ") for _ in range(rng.randint(1, 4))), None) for _ in range(4)]
        parts = [(i, "".join(rng.choice("00123") for _ in i)) for i, _ in parts]
        p = conversations.Repair()
        tables = [conversations.block_table(i, f, k == 3, p) for k, (i, f) in enumerate(parts)]
        left = conversations.joined(conversations.joined(conversations.joined(*tables[:2]), tables[2]), tables[3])
        right = conversations.joined(conversations.joined(*tables[:2]), conversations.joined(*tables[2:]))
        assert left == right
        way = conversations.way_through(tables, 0, conversations.ENDS)
        audit = "".join(conversations.audit_between(i, f, a, b, k == 3, p) for k, ((i, f), a, b) in enumerate(zip(parts, [0, *way], way)))
        assert audit == brute_edits("".join(i for i, _ in parts), "".join(f for _, f in parts))[1]


# --- all three ----------------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string"), ("pages", "page_id long, url string, html string"), ("conversations", SCHEMA)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for run in (Q.op11_periodic_runs, Q.op12_warc_normaliser, Q.op13_conversation_repair):
        assert run(spark, str(tmp_path)).count() == 0
