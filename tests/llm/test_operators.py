"""Each operator against brute force, and on the odd table and the empty one."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spotloom.llm import bytewords as W
from spotloom.llm import decontaminate, frames, language_id, media, neardup, packing, quality, secrets, sharding, toxicity, warc
from spotloom.llm.frames import pick, table

FOLD = {i: i + 32 for i in range(65, 91)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for abc, pattern in ((W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        clean = [t and t.encode("utf-8", "replace").decode() for t in texts]
        h, offs = W.word_hashes(pa.array(clean, pa.string()), abc)
        want = [re.findall(pattern, (t or "").translate(FOLD)) for t in clean]
        assert np.diff(offs).tolist() == [len(w) for w in want]
        seen = {}
        for word, code in zip([w for ws in want for w in ws], h.tolist()):
            assert seen.setdefault(word, code) == code
        assert len(set(seen.values())) == len(seen)


def test_long_documents_are_hashed_in_pieces_alike():
    text = "word " * 100_000 + "x" * 600_000 + " end"
    h, offs = W.word_hashes(pa.array(["a", text, "end"]), W.NOT_SPACE)
    assert np.diff(offs).tolist() == [1, 100_002, 1] and len(set(h[1:100_001].tolist())) == 1 and h[-1] == h[-2]


def test_pick_takes_exact_names_among_clashing_ones(odd_docs):
    assert pick(odd_docs, t="text").where("t = 'clash'").isEmpty()


# near-duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (len(s), group[i]) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=k).collect()}
        assert got == brute_components(rows, k, 80)


@pytest.mark.parametrize("hot", [frames.HOT_ROWS, 2])
def test_near_copies_that_are_linked_in_chains(spark, monkeypatch, hot):
    """Copies of one text with more and more edits: only neighbours in the chain are similar enough."""
    whole = frames.deal
    monkeypatch.setattr(frames, "deal", lambda left, key, scratch, name: whole(left, key, scratch, name, hot))
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[(i * 37) % 200] = f"new{i}"
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}


def test_one_star_with_very_many_members(spark):
    """Each copy has an edit of its own, so no two are equal, and all are near the first: a star, confirmed in parts."""
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))] + [(i, " ".join([*words, f"n{i}"])) for i in range(1, 30_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = neardup.near_duplicates(docs, shingle=4)
    assert got.where("component_id = 0").count() == 30_001


def test_rows_stay_or_go_by_their_own_text(spark):
    base, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, base, 1), (2, base, 2), (2, other, 3), (5, "alone " + other[:40], 4), (5, "alone " + other[:40], 5), (None, base, 6), (None, base, 7), (3, other, 8), (1, base, 9)]
    docs = spark.createDataFrame(rows, "Doc_ID long, text string, n long")
    kept = sorted(r.n for r in neardup.keep_one_of_each(docs, shingle=4).collect())
    assert kept[0] in (1, 9) and kept[1:] in ([3, 4, 6, 7], [3, 5, 6, 7], [3, 4, 6, 7, 9])[:2] or kept == [3, 4, 6, 7, 9]
    assert len(kept) == 5


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs, shingle=4).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id == 1 and not r.kept for r in by[2]) and len(by[2]) == 2
    assert by[9][0].component_id == 1 and by[1][0].kept
    assert by[3][0].n_shingles == 0 == by[4][0].n_shingles == by[6][0].n_shingles and by[4][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert by[7][0].n_shingles == 1 and by[5][0].n_shingles == 6
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.keep_one_of_each(odd_docs, shingle=4)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (2, 9)").isEmpty()


def test_densification_fills_every_bin_alike():
    s = np.unique(W.mix(np.arange(1, 4, dtype=np.uint64)))
    a, b = neardup.signatures([s]), neardup.signatures([s, np.unique(W.mix(np.arange(9, dtype=np.uint64)))])
    assert (a[0] == b[0]).all() and np.isin(a[0], s).all()


# decontamination


def brute_overlaps(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall((t or "").translate(FOLD))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = pattern.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_overlaps_equal_brute_force(spark, sf_dir, odd_docs, bound):
    bench = table(spark, sf_dir, "benchmark").unionByName(
        spark.createDataFrame([(900, "one TWO three"), (901, "thirteen"), (902, ""), (903, None), (904, "two three four five six seven eight nine ten eleven twelve"), (905, "one two three")], "item_id long, text string")
    )
    items = [(r.item_id, r.text) for r in bench.collect()]
    for docs in (table(spark, sf_dir, "documents"), odd_docs):
        got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_overlaps(docs, bench, broadcast_windows=bound).collect()], key=str)
        assert got == brute_overlaps([(r[0], r[1]) for r in pick(docs, i="doc_id", t="text").collect()], items)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_rows_with_a_hit_go_whatever_their_ids(spark, odd_docs, no_docs, bound):
    """Of rows that repeat an id or have none, only those with a hit go, on both paths."""
    span = " ".join(f"s{i}" for i in range(12))
    rows = [(1, "clean text", 1), (1, f"with {span} inside", 2), (None, "also clean", 3), (None, span, 4), (2, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, n long")
    bench = spark.createDataFrame([(7, span)], "item_id long, text string")
    assert sorted(r.n for r in decontaminate.keep_clean(docs, bench, broadcast_windows=bound).collect()) == [1, 3, 5]
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten"), (8, "é")], "item_id long, text string")
    kept = decontaminate.keep_clean(odd_docs, bench, broadcast_windows=bound)
    assert kept.columns == odd_docs.columns and sorted(str(r[0]) for r in kept.collect()) == ["10", "3", "4", "5", "6", "8"]
    assert decontaminate.keep_clean(no_docs, bench, broadcast_windows=bound).count() == 0


def test_overlaps_without_items_or_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    for bound in (10, -1):
        assert decontaminate.find_overlaps(odd_docs, none, broadcast_windows=bound).where("n_hit > 0").isEmpty()
    assert decontaminate.find_overlaps(no_docs, none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 30), st.integers(10, 40), st.integers(0, 30), st.integers(0, 10_000))
def test_winnowing_keeps_a_print_of_every_shared_span(before, span, after, seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 1 << 60, before + span + after).astype(np.uint64)
    item = words[before : before + span]
    a, b = W.ngrams(words, decontaminate.K), W.ngrams(item, decontaminate.K)
    assert np.isin(a[decontaminate.winnow(a)][:], b[decontaminate.winnow(b)]).any()


# secrets


def brute_spans(text):
    out = []
    for kind in ("assign", "access", "hex"):
        pattern, holds = secrets.RULES[kind]
        out += [(m.start(), secrets.KINDS.index(kind), m.end()) for m in pattern.finditer(text or "") if holds(m)]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "TOKEN", "api_key", "apikey", "=", ": ", '"', "abc123", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeef", "0123456789", "é", "İ", "ſecret", " ", "g", "\n"]), max_size=25))
def test_base_spans_equal_plain_patterns(parts):
    text = "".join(parts)
    assert [s for s in secrets.find(text) if s[0] in ("assign", "access", "hex")] == brute_spans(text)


def test_checksums_decide_over_tokens():
    body = "A" * 30
    good, bad = f"ghp_{body}{secrets.base62_crc(body)}", f"ghp_{body}000000"
    assert ("github", 4, 44) in secrets.find("my: " + good) and not [s for s in secrets.find(bad) if s[0] == "github"]


@pytest.mark.parametrize("label", ["PRIVATE KEY", "RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", '\\n" +\n  "'])
def test_private_keys_are_cut_whole(label, end):
    body = [base64.b64encode(bytes((i * k) % 251 for i in range(48))).decode() for k in range(3, 9)] + ["Zm9vYg==", "=njUN"]
    head, foot = f"-----BEGIN {label}-----", f"-----END {label}-----"
    armour = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,7F0A", ""]
    clean = lambda text: secrets.redact(text, secrets.find(text))
    for lines in (body, armour + body):
        key = end.join([head, *lines])
        assert clean(f"a {key}{end}{foot}{end}b") == f"a [redacted]{end}b"
        assert clean(f"a {key}") == "a [redacted]" and clean(f"a {key}{end}so it goes on") == f"a [redacted]{end}so it goes on"
        twice = clean(f"{key}{end}{key}{end}{foot}")
        assert not any(line in twice for line in lines if line)
    assert clean(f"a line {head} is no key, {'x ' * 50}") == f"a line [redacted] is no key, {'x ' * 50}"


def test_private_key_headers_without_end_take_linear_time():
    text = "-----BEGIN PRIVATE KEY-----\nno key here - at all\n" * 20_000
    start = time.process_time()
    assert len(secrets.find(text)) == 20_000 and time.process_time() - start < 20


def test_secrets_of_odd_rows_and_redaction(spark, odd_docs, no_docs):
    assert secrets.scan_secrets(odd_docs).count() == 12 and secrets.scan_secrets(no_docs).count() == 0
    text = "é password=hunter22 and deadbeefdeadbeefdeadbeef0."
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.redacted == "é [redacted] and [redacted]." and [text[s.start : s.end] for s in row.spans][0] == "password=hunter22"
    docs = spark.createDataFrame([(1, text, 5, "k"), (2, "plain", 5, None)], "doc_id int, text string, n_chars long, other string")
    assert sorted(map(tuple, secrets.redact_columns(docs).collect())) == [(1, "é [redacted] and [redacted].", 28, "k"), (2, "plain", 5, None)]


def test_query_of_secrets_equals_plain_patterns(spark, sf_dir):
    from spotloom.llm import registry

    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    for r in registry.op6_secrets(spark, sf_dir).collect():
        want = brute_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(secrets.said(want).encode()).hexdigest()
        found = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert [x for x in found if x[0] in ("assign", "access", "hex")] == want


# archives


def test_archives_round_trip(spark):
    big = "é" * 200_000
    rows = [(1, "http://a b/", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (2, "u", "x" * 100), (None, "u", "x" * 100), (7, "u", big), (8, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"))).collect()
    assert len(got) == 10 and all(r.error is None for r in got)
    kinds = sorted((r.record_id or "", r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "response", None), ("2", "revisit", "1"), ("2", "revisit", "1"), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("", "revisit", "1"), ("7", "response", None), ("8", "revisit", "7")])
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {r.payload_bytes for r in got if r.record_id in ("7", "8")} == {400_000}
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.where("false"), "page_id", "url", "html"))).count() == 0


def test_a_page_that_repeats_very_often_is_no_task_of_its_own(spark):
    """Pages stay where they are: there is no shuffle of payloads, so the largest task has no more than its share."""
    pages = spark.range(0, 100_000, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 200).alias("html"))
    planned = warc.plan_records(pages, "page_id", "url", "html")
    sizes = planned.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) <= 2 * 12_500
    assert planned.where("refers_to = 0").count() == 99_999


def test_more_repeated_digests_than_may_be_broadcast(spark, monkeypatch):
    from spotloom.llm import frames

    monkeypatch.setattr(frames, "HOT_KEYS", 2)
    rows = [(i, "u", str(i % 5) * 150 if i % 7 else "z" * 200) for i in range(200)] + [(None, None, "z" * 200), (500, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    least = {}
    for i, _, h in rows:
        if h and i is not None:
            least.setdefault(h, i)
    got = {(r.page_id, r.refers_to) for r in warc.plan_records(pages, "page_id", "url", "html").collect()}
    assert got == {(i, None if not h or least[h] == i else least[h]) for i, _, h in rows}


def test_ids_of_any_kind_come_back(spark):
    pages = spark.createDataFrame([("a b>", "u", "x" * 120), ("é/1", "u", "x" * 120), ("", "u", ""), (None, "u", "")], "page_id string, url string, html string")
    got = sorted(((r.record_id, r.refers_to) for r in warc.read_archives(warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"))).collect()), key=str)
    assert got == sorted([("a b>", None), ("é/1", "a b>"), ("", None), (None, None)], key=str)


def test_damaged_archives_say_so():
    one, two = warc.record("response", "1", None, b"a" * 500, None), warc.record("response", "2", None, b"b" * 500, None)
    assert [r["record_id"] for r in warc.read_archive(one + two)] == ["1", "2"]
    cut = list(warc.read_archive(one + two[:-20]))
    assert cut[0]["record_id"] == "1" and "cut off" in cut[1]["error"]
    fields, block = warc.parse(zlib.decompress(one, 31))
    wrong = zlib.decompress(one, 31).replace(b"a" * 500, b"a" * 499 + b"c")
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert "digest" in list(warc.read_archive(c.compress(wrong) + c.flush()))[0]["error"]


# media


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 1500))
def test_media_round_trip(n):
    payload = bytes(np.random.default_rng(n).integers(0, 256, 64 * n, dtype=np.uint8))
    content = media.wrap_samples(payload)
    assert media.features(content)[0] == payload
    error, tracks = media.describe(content)
    assert error is None and tracks[0]["codec"] == "raw" and tracks[0]["samples"] == -(-len(payload) // 4096) and len(tracks[0]["keyframes"]) == -(-tracks[0]["samples"] // 8)


def test_media_of_odd_rows_and_damage(spark, odd_docs, no_docs):
    assert media.store_texts(odd_docs).count() == 12 and media.store_texts(no_docs).count() == 0
    good = media.wrap_samples(bytes(64))
    files = spark.createDataFrame([(1, good), (2, good[:100]), (3, None), (4, b"")], "id int, content binary")
    got = {r.id: r for r in media.index_media(files, "id", "content").collect()}
    assert got[1].error is None and got[1].tracks[0].keyframes[0].end == len(good) and got[2].error and got[3].error == "empty" == got[4].error


def _fragmented(samples: list[bytes], table: bytes = b"") -> bytes:
    """A file whose samples are in two fragments, the first with sizes a sample, the second with the default one."""
    from spotloom.llm.media import box, full

    def full_u(kind, flags, *numbers, version=0):
        return full(kind, version, flags, b"".join(n.to_bytes(4, "big", signed=n < 0) for n in numbers))

    stbl = box(b"stbl", full_u(b"stsd", 0, 0), full_u(b"stts", 0, 0), full_u(b"stsc", 0, 0), full_u(b"stsz", 0, 0, 0), full_u(b"stco", 0, 0))
    mdia = box(b"mdia", full_u(b"mdhd", 0, 0, 0, 1000, 0, 0), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    moov = box(b"moov", box(b"trak", full_u(b"tkhd", 0, 0, 0, 9, 0, 0), mdia), box(b"mvex", full_u(b"trex", 0, 9, 1, 40, len(samples[-1]), 0x10000)))
    out = box(b"ftyp", b"isom", bytes(4)) + moov
    for part, flags in ((samples[:-2], 0x205), (samples[-2:], 0x1)):
        def moof(offset, part=part, flags=flags):
            numbers = [len(part), offset, *((0, *map(len, part)) if flags & 0x200 else ())]
            return box(b"moof", full_u(b"mfhd", 0, 1), box(b"traf", full_u(b"tfhd", 0x20000, 9), full_u(b"trun", flags, *numbers)))
        out += moof(len(moof(0)) + 8) + box(b"mdat", *part)
    return out


def test_fragments_are_read():
    samples = [b"a" * 5, b"b" * 7, b"c" * 3, b"d" * 4, b"e" * 4]
    content = _fragmented(samples)
    _, (track,) = media.read_tracks(content)
    assert media.sample_bytes(content, track) == b"".join(samples) and track.keyframes().tolist() == [0] and track.duration == 200
    error, (row,) = media.describe(content)
    assert error is None and row["samples"] == 5 and content[row["keyframes"][0]["start"] : row["keyframes"][0]["end"]] == samples[0]
    assert media.describe(content[:-9])[0]


def test_tables_that_name_more_than_the_file_holds_are_errors():
    good = media.wrap_samples(bytes(64 * 200))

    def changed(kind, at, *numbers):
        place = good.index(kind) + 4 + at
        return good[:place] + b"".join(n.to_bytes(4, "big") for n in numbers) + good[place + 4 * len(numbers) :]

    for bad in (changed(b"stsz", 4, 1, 1 << 30), changed(b"stsz", 4, 0, 1 << 31), changed(b"stsc", 8, 1, 1 << 31, 1), changed(b"stsc", 8, 1 << 31), changed(b"co64", 8, 0xFFFFFFFF, 0), changed(b"stss", 8, 77), changed(b"stts", 4, 1 << 30)):
        assert media.describe(bad)[0] and media.describe(bad)[1] == []


def test_query_of_media_equals_plain_python(spark, sf_dir):
    from spotloom.llm import registry

    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = registry.op10_media(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        content = media.wrap_samples(payload)
        at, n = content.index(payload), -(-len(payload) // 4096)
        keys = ",".join(f"{at + 4096 * k}-{at + min(4096 * (k + 1), len(payload))}" for k in range(0, n, 8))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(content), hashlib.sha256(content).hexdigest())
        assert r.feature == f"codec=raw;size=64x64;samples={n};duration={n * 0.04:.3f};keyframes={keys}"


# shards


def test_shards_merge_and_commit(spark, tmp_path, odd_docs, no_docs):
    docs = odd_docs.drop("TEXT")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3)
    for _ in range(3):
        store.append(docs)
    store.append(no_docs.drop("TEXT"))
    assert store.read().count() == 36 and len(store.shards()) == 4
    assert store.compact(small_bytes=1 << 18) >= 1 and store.read().count() == 36 and len(store.shards()) < 4
    want = sorted(map(str, docs.union(docs).union(docs).collect()))
    assert sorted(map(str, store.read().collect())) == want
    base = store.manifest()
    store.append(docs)
    with pytest.raises(sharding.Conflict):
        store.commit(base, store.shards(), docs.schema)
    left = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("shard-")}
    assert {s.name for s in store.shards()} <= left and not list((tmp_path / "s" / "_manifests").glob(".draft*"))


def test_writers_follow_each_other(spark, tmp_path):
    root, rows = str(tmp_path / "s"), spark.range(10)
    a, b = sharding.ShardStore(spark, root, fan_in=2, keep_versions=1), sharding.ShardStore(spark, root, fan_in=2)
    a.append(rows)
    stale, fresh = a.manifest(), a.manifest
    b.append(rows)
    seen = iter([stale, stale])  # a reads a version that b has since followed
    a.manifest = lambda version=None: next(seen, None) or fresh(version)
    a.append(rows)
    a.manifest = fresh
    assert a.read().count() == 30 and len(a.shards()) == 3
    reader = a.read()
    assert a.compact(small_bytes=1) >= 1 and reader.count() == 30 == a.read().count()
    a.vacuum()
    assert reader.count() == 30
    a.vacuum(older_than_s=0)
    left = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith(("shard-", "draft-"))}
    assert left == {s.name for s in a.shards()} and a.versions() == a.versions()[-1:]
    run, load = a.shards(), a._load
    a._load = lambda shards, schema: (b.commit(b.manifest(), [], schema), load(shards, schema))[1]  # b removes the run meanwhile
    assert not a._merge(run, rows.schema) and a.shards() == []


def test_arrivals_come_from_one_pass(spark, tmp_path, odd_docs, no_docs):
    docs = odd_docs.drop("TEXT")
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    versions = store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    assert len(store.shards()) == len(versions) > 1 and sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    empty = sharding.ShardStore(spark, str(tmp_path / "e"))
    assert empty.read(schema=docs.schema).count() == 0
    empty.append_each(no_docs.drop("TEXT"), F.lit(1))
    assert empty.read().count() == 0 and empty.read().columns == docs.columns


def test_shards_reach_the_target(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=200_000, fan_in=4)
    rows = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for i in range(8):
        store.append(rows.where(F.col("id") % 8 == i))
        store.compact(small_bytes=50_000)
    store.compact(small_bytes=50_000, everything=True)
    assert store.read().select("id").distinct().count() == 40_000 == store.read().count()
    assert all(100_000 <= s.bytes / s.files <= 400_000 for s in store.shards())


# packing


def test_packing_is_gapless_and_tight(spark, sf_dir, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for docs in (table(spark, sf_dir, "documents"), odd_docs):
        got = packing.pack(docs, tokenizer=path).collect()
        texts = [(r.doc_id, r.text or "") for r in pick(docs, doc_id="doc_id", text="text").collect()]
        ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in texts}
        places = {}
        for r in got:
            own = ids[r.doc_id]
            assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.start == (0 if r.piece == 0 else (len(own) % 1024 or 1024) + 1024 * (r.piece - 1))
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            p.sort()
            assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p[:-1], p[1:])) and sum(p[-1]) <= 1024
        total = sum(len(ids[i]) for i, _ in texts)
        assert sum(r.length for r in got) == total and len(places) <= 1.02 * total / 1024 + 1
    assert packing.pack(no_docs, tokenizer=path).count() == 0


def test_ids_are_those_of_an_unchanged_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.whole_encoder(path)
    parts = ["a", " ", "\n", "\x1c", "\u3000", "<|endoftext|>", "<|endoftext", "é's 12"]
    texts = [x + y + z for x in parts for y in parts for z in parts]
    gap = 1_200_000
    texts += [" " * gap, "a" + "\n" * gap, " " * gap + "b", "a" + "\u2003 " * (gap // 2) + "<|endoftext|>" + " \n" * gap + "\x1d", "a" * gap, ("x" + " " * 999 + "y" + " " * 1000) * 60]
    for text in texts:
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 500)), min_size=1, max_size=12))
def test_plans_use_each_piece_once(lengths):
    counts = np.zeros(65, np.int64)
    for length, n in lengths:
        counts[length] += n
    used = np.zeros(65, np.int64)
    for c, m in packing.plan(counts, 64):
        assert sum(length * a for length, a in c.items()) <= 64
        for length, a in c.items():
            used[length] += a * m
    assert (used == counts).all()
    p = packing.Placement(packing.plan(counts, 64), 64)
    length = np.repeat(np.arange(65), counts)
    number = np.concatenate([np.arange(n) for n in counts])
    seq, off = p.place(length, number)
    cells = np.concatenate([s * 64 + np.arange(o, o + n) for s, o, n in zip(seq.tolist(), off.tolist(), length.tolist())])
    assert len(np.unique(cells)) == len(cells)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_program_places_nine_in_ten_pieces_and_as_well_as_best_fit(name):
    """Lengths as documents have them: whole sequences, and odd rests of all lengths."""
    rng = np.random.default_rng(3)
    n = {"sf0.001": 200, "sf0.01": 1000, "sf0.1": 10_000}[name]
    counts = np.bincount(np.clip(rng.lognormal(5.9, 0.9, n), 1, 1023).astype(int), minlength=1025)
    counts[1024] = n // 2
    planned = packing.plan(counts, 1024)
    used = sum(m for _, m in planned)
    assert used <= sum(m for _, m in packing.best_fit(counts, 1024)) + 1
    rest = counts.copy()
    rest[1024] = 0
    raw = packing.rounded(packing.configuration_program(rest, 1024), rest, 1024)
    again = packing.mended(raw, 1024, int(counts.sum()) // packing.MEND)
    times = [Counter() for _ in range(2)]
    for found, plan in zip(times, (raw, again)):
        for c, m in plan:
            found[tuple(sorted(c.items()))] += m
    same = sum(min(m, times[0][c]) * sum(k for _, k in c) for c, m in times[1].items())
    assert same + counts[1024] >= 0.9 * counts.sum()


def test_few_pieces_are_planned_by_the_program_too():
    counts = np.zeros(65, np.int64)
    counts[[15, 16, 21, 34]] = 51, 49, 8, 22
    assert sum(m for _, m in packing.best_fit(counts, 64)) == 44 and sum(m for _, m in packing.plan(counts, 64)) == 39


def test_other_tokenizers_are_left_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), packing.whole_encoder(path)
    assert isinstance(e, packing.Slow) and isinstance(packing.whole_encoder(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder)
    for text in ("Two  Words <|endoftext|> é", "", " " * 2_000_000):
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_archives_take_exact_names_among_clashing_ones(spark):
    rows = [(1, "u", "x" * 200, "no", -1, "w"), (2, "v", "x" * 200, "no", -1, "w"), (3, None, None, "no", -1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML string, Page_Id int, refers_to string")
    got = {r.record_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"))).collect()}
    assert got == {"1": (200, "response", None), "2": (200, "revisit", "1"), "3": (0, "response", None)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_texts_take_no_more_sequences_than_best_fit(spark, sf):
    from spotloom.llm.registry import tokenizer_path

    pieces = packing.cut(table(spark, f"/root/testdata/{sf}", "documents"), "doc_id", "text", tokenizer_path(), 1024, 2)
    counts = np.zeros(1025, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r.length] = r["count"]
    planned = packing.plan(counts, 1024)
    used = np.zeros(1025, np.int64)
    for c, m in planned:
        assert m > 0 and sum(x * times for x, times in c.items()) <= 1024
        for x, times in c.items():
            used[x] += times * m
    assert (used == counts).all()
    assert sum(m for _, m in planned) <= sum(m for _, m in packing.best_fit(counts, 1024))


def test_packing_anew_is_bounded_and_never_takes_more(monkeypatch):
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 60, 400), minlength=101)
    poor = [({x: 1}, int(n)) for x, n in enumerate(counts) if n]
    assert packing.repacked(poor, 100, 1 << 60) is not poor and sum(m for _, m in packing.repacked(poor, 100, 1 << 60)) == 400
    for spare in (2000, 30, 1, 0):
        monkeypatch.setattr(packing, "SPARE", spare)
        new = packing.repacked(poor, 100, 0)
        used = np.zeros(101, np.int64)
        for c, m in new:
            assert m > 0 and sum(x * k for x, k in c.items()) <= 100
            for x, k in c.items():
                used[x] += k * m
        assert (used == counts).all() and sum(m for _, m in new) <= 400
    assert packing.repacked([], 100, 0) == []


# classifiers


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_held_out_accuracy(spark):
    from spotloom.llm import registry

    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels").toPandas().set_index("doc_id")
    for name, column, least in (("op3_toxicity", "toxic", 0.97), ("op8_quality", "quality", 0.99)):
        got = registry.QUERIES[name](spark, d).toPandas().join(labels, on="doc_id", how="inner")
        held = got[got.held_out]
        assert got.score.between(0, 1).all() and auc(held.score.to_numpy(), held[column].to_numpy()) > least
    langs = table(spark, d, "documents").select("doc_id", "lang").toPandas()
    held = registry.op1_language_id(spark, d).toPandas().merge(langs, on="doc_id").query("held_out")
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_scores_equal_plain_loops_over_what_was_learned(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts = dict(docs.select("doc_id", "text").collect())
    sample = sorted(texts)[::9]

    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i in sample:
        buckets = sorted({int(b) for b in toxicity.terms(pa.array([texts[i]], pa.string()))[0]})
        live = [b for b in buckets if model.weights[b]]
        z = model.bias + sum(model.weights[b] for b in live)
        z += sum(float(model.factors[model.place[a]] @ model.factors[model.place[b]]) for k, a in enumerate(live) for b in live[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6

    lang = language_id.fit(docs)
    found = {r.doc_id: r for r in language_id.predict(docs, lang).collect()}
    for i in sample:
        text = (texts[i] or "").lower()
        z, total = np.zeros(len(lang.languages)), 0
        for n in (1, 2, 3):
            for j in range(len(text) - n + 1):
                codes = np.array([ord(c) for c in text[j : j + n]], np.uint32)
                bucket = next(b for k, (_, b) in enumerate(language_id.grams(codes, np.array([0, n]))) if k == n - 1)[0]
                z, total = z + lang.weights[bucket], total + 1
        p = np.exp((z / max(total, 1) + lang.bias) / lang.temperature)
        p /= p.sum()
        if any(c.isalpha() for c in text):
            assert found[i].lang_pred == lang.languages[int(p.argmax())] and abs(found[i].score - p.max()) < 1e-4

    stats = quality.measure(docs)
    grade = quality.fit(stats, labels)
    scores = {r.doc_id: r.score for r in quality.score(stats, grade).collect()}
    for r in stats.where(F.col("doc_id").isin(sample)).collect():
        x, log = np.array(r.stats), []
        for k in (0, 1):
            cov = np.linalg.inv(grade.factors[k].T @ grade.factors[k])
            d = x - grade.means[k]
            log.append(-0.5 * (d @ np.linalg.solve(cov, d) + np.log(np.linalg.det(cov))))
        z = (log[1] - log[0]) / quality.SOFTEN + np.log(grade.prior / (1 - grade.prior))
        assert abs(scores[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -500, 500)))) < 1e-6


def test_pairs_of_terms_are_learned():
    """Neither term says anything alone: label 1 is one of two without the other."""
    rng = np.random.default_rng(1)
    rows = [(int(a != b), np.array(sorted([x for x, on in ((3, a), (4, b), (5, True)) if on]), np.int64)) for a, b in rng.integers(0, 2, (4000, 2)).astype(bool)]
    model = toxicity.train(rows)
    right = sum((model.logits(b, np.array([0, len(b)]))[0] > 0) == bool(y) for y, b in rows)
    assert right >= 0.99 * len(rows)


def test_samples_are_bounded_and_know_no_order(spark):
    from spotloom.llm.samples import per_class, row_hash

    rows = spark.range(100_000).select(F.when(F.col("id") < 60_000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a text that is toxic").alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    drawn, _ = per_class(rows, "toxic", row_hash("doc_id"), 500)
    assert [r["count"] for r in drawn.groupBy("toxic").count().collect()] == [500, 500]
    sized, _ = per_class(rows, "toxic", row_hash("doc_id"), 500, F.lit(1000), 20_500)
    assert [r["count"] for r in sized.groupBy("toxic").count().collect()] == [20, 20]
    assert per_class(rows, "toxic", row_hash("doc_id"), 500, F.lit(1000), 10)[0].count() == 2  # one of each at least
    assert per_class(rows, "toxic", row_hash("doc_id"), 500, total=60)[0].count() == 60
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 11} common", "en" if i % 2 else "de", int(i % 7 == 0)) for i in range(600)], "doc_id long, text string, lang string, toxic int")
    other = docs.orderBy(F.desc("doc_id")).repartition(7)
    one, two = (toxicity.fit(d, d, fit_per_class=60) for d in (docs, other))
    assert one.bias == two.bias and (one.weights == two.weights).all()
    one, two = (language_id.fit(d, fit_per_class=60) for d in (docs, other))
    assert (one.weights == two.weights).all() and one.temperature == two.temperature
    dirty = docs.withColumn("lang", F.concat("lang", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise(F.lit(""))))
    assert language_id.fit(dirty).languages == sorted(r.lang for r in dirty.select("lang").distinct().collect())


def test_languages_of_repeated_rows_and_very_many_languages_are_learned(spark):
    """However a language's few distinct rows hash, and however often they are repeated beside many distinct ones."""
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the house is by the river "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    for i in range(4):
        same = spark.range(10_000).select(F.lit(90_000 + i).cast("bigint").alias("doc_id"), F.lit("où est la forêt près du château").alias("text"), F.lit("fr").alias("lang"))
        model = language_id.fit(many.unionByName(same), fit_per_class=50)
        assert model.languages == ["en", "fr"]
        got = language_id.predict(spark.createDataFrame([(1, "la forêt est près du château"), (2, "the river is by the house")], "doc_id long, text string"), model)
        assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "fr", 2: "en"}
    words = spark.range(130 * 6).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 130).cast("string")).alias("lang"))
    words = words.withColumn("text", F.repeat(F.concat(F.char(97 + F.col("doc_id") % 13), F.char(97 + (F.col("doc_id") % 130 / 13).cast("int")), F.lit(" ")), 20))
    model = language_id.fit(words, fit_rows=400)
    assert len(model.languages) == 130
    right = language_id.predict(words, model).join(words.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert right > 0.9 * 780


def test_samples_of_long_texts_are_bounded_in_bytes(spark):
    docs = spark.range(24).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 60_000).alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = docs.withColumn("text", F.concat("text", F.when(F.col("toxic") == 1, F.repeat(F.lit("awful "), 50)).otherwise(F.lit(""))))
    model = toxicity.fit(docs, docs, fit_bytes=2 << 20)  # five or so texts of each label
    assert np.isfinite(model.bias)
    seen = []
    whole = frames.map_batches

    def watch(df, fn, schema):
        seen.append(df)
        return whole(df, fn, schema)

    frames.map_batches, old = watch, frames.map_batches
    try:
        toxicity.fit(docs, docs, fit_bytes=2 << 20)
    finally:
        frames.map_batches = old
    assert len(seen) == 1 and "Join" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_classifiers_on_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert {got[i].lang_pred for i in (3, 4, 6, 8)} == {"und"} and got[10].lang_pred in ("de", "en", "fr") and 0 <= got[1].score <= 1
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"} and language_id.predict(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (9, 0, 1), (4, None, None), (None, 1, 1), (3, 1, 1), (10, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    empty = labels.where("false")
    for lab in (labels, empty, labels.where("doc_id = 1")):
        tox = toxicity.score(odd_docs, toxicity.fit(odd_docs, lab)).collect()
        stats = quality.measure(odd_docs)
        qual = quality.score(stats, quality.fit(stats, lab)).collect()
        assert len(tox) == 12 == len(qual) and all(0 <= r.score <= 1 for r in [*tox, *qual])
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_frequencies_count_each_text_once(spark):
    freq, n = language_id.document_frequencies(spark.createDataFrame([("aab" * 5,), ("b",), ("",), (None,)], "text string"))
    assert n == 4
    b = [int(x[0]) for _, x in language_id.grams(np.array([ord("b")], np.uint32), np.array([0, 1])) if len(x)][0]
    a = [int(x[0]) for _, x in language_id.grams(np.array([ord("a")], np.uint32), np.array([0, 1])) if len(x)][0]
    assert (freq[a], freq[b]) == (1, 2) and freq.max() == 2
