"""The training-data operators against plain versions, and their edge cases: nulls, empty and long texts, repeats, no rows."""

import base64
import bz2
import gzip
import hashlib
import itertools
import json
import lzma
import pkgutil
import random
import re
import textwrap
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fellscan.llm import cotraining, exact_dedup, license_scan, mixing, ngram_join, piece_dropout, pretokens, quality_rules, secret_scan, token_count, token_store
from fellscan.llm.common import shared_folder
from fellscan.llm.graph import components

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, row string, size string"
EDGES = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "one two"), (900_005, "One  TWO"), (900_005, "One  TWO"), (None, "no id here"), (None, None), (900_006, "long " * 30_000 + "end."), (900_007, "İ ß ſ ▁ \U0001f600 <|endoftext|> don't 12½ a\x1cb")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest scale with the edge cases, and columns whose names the operators use inside."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(i, t, None, None if k % 2 else "edge", None) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame([(*r, "d", "k", "r", "s") for r in rows], SCHEMA).persist()


def texts(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.select("doc_id", "text", "source").collect()]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_token_counts_and_store(spark, docs):
    path = P.path("word_bpe_49k.json")
    ids = [(i, t, pretokens.library_ids(path, t)) for i, t, _ in texts(docs)]
    got = sorted(map(tuple, token_count.token_counts(docs, path, 100).collect()), key=str)
    assert got == sorted([(i, len(t.encode()), len(x), len(x) > 100) for i, t, x in ids], key=str)
    folder = shared_folder(spark, "test-store")
    token_store.write_store(docs, folder, path, 2, segment_ids=3000)
    start, want = 0, []
    for i, _, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        x = np.array([*x, 2], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, token_store.read_documents(spark, folder).collect()), key=lambda r: r[1]) == want
    segment = token_store.Segment(bytes(spark.read.parquet(f"{folder}/segments").where("n_docs > 1").first()["payload"]))
    ends = segment.ends.values()
    assert [segment.ends.select(k) for k in range(len(ends))] == ends.tolist() and len(segment.tokens(1)) == ends[1] - ends[0]
    empty = shared_folder(spark, "test-store")
    token_store.write_store(docs.limit(0), empty, path, 2)
    assert token_store.read_documents(spark, empty).count() == 0 == token_count.token_counts(docs.limit(0), path).count()


def test_whole_tokens_are_proved():
    path = P.path("word_bpe_49k.json")
    whole = pretokens.whole_tokens(path)
    assert len(whole) > 20_000 and all(len(pretokens.library_ids(path, w)) == 1 for w in list(whole)[:200])


def test_elias_fano_of_many_shapes():
    for v in ([], [0], [5, 5, 5], list(range(1000)), sorted(random.Random(1).randrange(10**9) for _ in range(3000)), [0, 2**40]):
        e = token_store.EliasFano(token_store.ef_encode(np.array(v, np.int64)))
        assert e.values().tolist() == v and [e.select(k) for k in range(0, len(v), 7)] == v[::7]


def test_piece_dropout(spark, docs):
    path = P.path("piece_bpe_32k.model")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = piece_dropout.Encoder(path, 1, 0.0, 1)
    for t in ["", " ", "  a  b ", "a\n\nb", "x  \n  y", "漢字 é", *(t for _, t, _ in texts(docs)[:60])]:
        assert np.frombuffer(plain.encode(t, 0), "<i4").tolist() == library.encode(t)
    out = piece_dropout.encode(docs, path)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    assert sorted(r.ids_crc32 for r in piece_dropout.encode(docs, path).collect()) == sorted(r.ids_crc32 for r in rows)
    assert len({plain.encode("this is another example", 0), *(piece_dropout.Encoder(path, s, 0.3, 1).encode("this is another example", 0) for s in range(20))}) > 3
    back = sorted((r.doc_id, r.text) for r in piece_dropout.decode(out.where("doc_id IS NOT NULL"), path).collect())
    assert back == sorted((i, t) for i, t, _ in texts(docs) if i is not None)
    assert piece_dropout.encode(docs.limit(0), path).count() == 0


def plain_dropout(model, word, gaps):
    """Merges one by one over a list of symbols, the best pair first; gaps as in Model.word."""
    symbols, skipped, left, since = [(i, c) for i, c in enumerate(word)], set(), gaps.pop(0), 0
    while True:
        pairs = [(model.costs[p], a[0], b[0], a[1] + b[1]) for a, b in zip(symbols, symbols[1:]) if (p := model.ids.get(a[1] + b[1])) is not None and (a[0], a[1] + b[1], b[0]) not in skipped]
        if not pairs:
            break
        _, i, j, merged = min(pairs)
        if since == left:
            left, since = gaps.pop(0), 0
            skipped.add((i, merged, j))
            continue
        since += 1
        symbols = [(k, merged if k == i else c) for k, c in symbols if k != j]
    return [x for _, c in symbols for x in ([model.ids[c]] if c in model.ids else [model.byte_ids[b] for b in c.encode()])]


def test_dropout_of_every_occurrence(spark):
    path = P.path("piece_bpe_32k.model")
    coder = piece_dropout.Encoder(path, 1, 0.2)
    rng, pool = random.Random(2), ["international", "segmentation,", "\u6f22\u5b57\u00e9!", "unbelievable" * 8, "of"]
    chosen = [rng.choice(pool) for _ in range(600)]
    ids, want = np.frombuffer(coder.encode(" ".join(chosen), 77), "<i4").tolist(), []
    for place, w in enumerate(chosen):
        want += plain_dropout(coder.model, " " + w, list(itertools.islice(coder._later(77, place), 100)))
    assert ids == want  # a remembered word is what merging it afresh gives
    assert len({tuple(plain_dropout(coder.model, " international", list(itertools.islice(coder._later(77, p), 50)))) for p in range(600)}) > 4
    assert len({coder.encode("international", k) for k in range(600)}) > 4
    share = sum(next(coder._later(9, p)) == 0 for p in range(20_000)) / 20_000
    assert abs(share - 0.2) < 0.015
    assert coder.decode(coder.encode("a" + "\u2014" * 50_000, 3)) == "a" + "\u2014" * 50_000  # no recursion a character


def test_copies_are_segmented_apart(spark):
    """Rows of one document, as mixing makes them, get ids of their own, the same however the rows are dealt."""
    path = P.path("piece_bpe_32k.model")
    text = "international organisations considered unbelievable segmentation"
    rows = [(1, text)] * 6 + [(2, text), (None, text), (None, text), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.copy, r.ids_crc32) for r in piece_dropout.encode(docs.repartition(5), path, rate=0.3).collect()), key=str)
    assert got == sorted(((r.doc_id, r.copy, r.ids_crc32) for r in piece_dropout.encode(docs.coalesce(1), path, rate=0.3).collect()), key=str)
    assert [c for i, c, _ in got if i == 1] == list(range(6)) and len({x for i, _, x in got if i == 1}) > 4
    alone = piece_dropout.encode(docs.where("doc_id = 2"), path, rate=0.3).first()
    assert (2, 0, alone.ids_crc32) in got  # not what stands beside it


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(docs):
    rows = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.secret_spans(docs).collect()), key=str)
    want = []
    for i, t, _ in texts(docs):
        b = plain_base(t)
        want.append((i, *(sum(x[1] == k for x in b) for k in range(3)), hashlib.sha256(secret_scan.written(b).encode()).hexdigest()))
    assert rows == sorted(want, key=str) and secret_scan.secret_spans(docs.limit(0)).count() == 0


def test_secret_layers_are_unwrapped_to_the_end():
    secret = 'password = "hunter2hunter2"'
    b64 = lambda b: base64.b64encode(b).decode()
    quoted = urllib.parse.quote(secret, safe="")
    for run in (b64(secret.encode()), quoted, b64(gzip.compress(secret.encode())), "".join(f"\\u{ord(c):04x}" for c in secret), "".join(f"&#{ord(c)};" for c in secret), urllib.parse.quote(b64(zlib.compress(b64(secret.encode()).encode())), safe=""), b64(quoted.encode()), urllib.parse.quote(quoted, safe="")):
        base, spans, entered, cut = secret_scan.scan(f"see {run} end")
        assert entered >= 1 and not cut and any(k == 0 and a >= 4 and b <= 4 + len(run) for a, k, b in spans), run
    assert secret_scan.scan("secret:token:abcdefgh token=api= ſecret=abcdefgh")[1] == []
    assert secret_scan.scan("%2525" * 50)[1] == []


def test_secret_layers_keep_their_line_and_place():
    twice = urllib.parse.quote(urllib.parse.quote("token='abcdef99'", safe=""), safe="")
    text = f"{twice}\nbetween\n{twice}\npassword: %73%65cret99\n\\u0041KIAABCDEFGH12345678 token=%61bcdef%FF"
    found = [text[a:b] for a, _, b in secret_scan.scan(text)[1]]
    assert found == [twice[: -len("%2527")]] * 2 + ["password: %73%65cret99", "\\u0041KIAABCDEFGH12345678", "token=%61bcdef"]
    frame = zstandard.ZstdCompressor().compressobj()  # a frame that does not tell its size
    data, cut = secret_scan.unpack(frame.compress(bytes(secret_scan.MAX_UNPACKED + 1)) + frame.flush())
    assert len(data) == secret_scan.MAX_UNPACKED and cut


def test_secret_layers_of_members_bytes_and_wrapped_lines():
    secret, noise = b"password = 'hunter2hunter2'", "".join(random.Random(4).choice("abcdefghij \n") for _ in range(3000)).encode()
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n: "\n".join(t[k : k + n] for k in range(0, len(t), n))
    packers = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]
    runs = {f"members {k}": b64(pack(noise) + pack(secret)) for k, pack in enumerate(packers)}
    runs |= {f"percent {k}": urllib.parse.quote(pack(secret), safe="") for k, pack in enumerate(packers)}
    runs |= {f"form {k}": urllib.parse.quote_plus(pack(secret)) for k, pack in enumerate(packers)}
    runs |= {f"repr {k}": repr(pack(secret)) for k, pack in enumerate(packers)}
    runs |= {f"escapes {k}": "".join(f"\\u{c:04x}" for c in pack(secret)) for k, pack in enumerate(packers)}
    runs |= {f"wrapped {n}": wrap(b64(noise[:200] + secret + noise[:500]), n) for n in (64, 76)}
    runs |= {f"wrapped gzip {n}": wrap(b64(gzip.compress(random.Random(1).randbytes(300) + b" " + secret)), n) for n in (64, 76)}
    runs |= {f"behind {k}": "p/x-"[:k] + b64(b"see " + secret) for k in range(1, 5)}
    runs |= {"latin-1": b64("caf\u00e9 ".encode("latin-1") + secret), "behind bytes": b64(b"head" + gzip.compress(secret))}
    for name, run in runs.items():
        text = f"see:\n{run}\nend."
        spans = secret_scan.scan(text)[1]
        assert any(k == 0 and 5 <= a and b <= 5 + len(run) for a, k, b in spans), name
    assert secret_scan.scan("x" + b64(random.Random(2).randbytes(5000)))[1] == []
    limit = secret_scan.MAX_UNPACKED
    data, cut = secret_scan.unpack(gzip.compress(bytes(limit - 5)) + gzip.compress(bytes(9)))
    assert len(data) == limit and cut  # the second member is cut, and said so


def test_exact_dedup(docs):
    groups = {}
    for i, t, _ in texts(docs):
        groups.setdefault(ascii_lower(t), []).append(i)
    stay = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for digest in (exact_dedup.sha256, lambda t: F.char_length(t).cast("string")):  # the second collides throughout
        kept = exact_dedup.without_copies(docs, digest)
        assert kept.columns == docs.columns
        assert sorted(((ascii_lower(r.text or ""), r.doc_id) for r in kept.collect()), key=str) == sorted(stay.items(), key=str)
    assert exact_dedup.without_copies(docs.limit(0)).count() == 0


def test_state_goes_on_with_more_input(spark, docs):
    """A second run of the stream on the same checkpoint adds to the state of the first."""
    folder, checkpoint = shared_folder(spark, "test-in"), shared_folder(spark, "test-state")
    table = exact_dedup.arrivals(docs.where("doc_id IS NOT NULL"))
    stream = lambda: spark.readStream.schema(table.schema).parquet(folder)
    table.where("doc_id < 100").write.parquet(folder)
    exact_dedup.keyed_state(stream(), checkpoint)
    table.where("doc_id >= 100").write.mode("append").parquet(folder)
    got = {(r.digest, r.n, r.keep_id) for r in exact_dedup.keyed_state(stream(), checkpoint).collect()}
    assert got == {(r.digest, r.n, r.k) for r in table.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("k")).collect()}


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(ascii_lower(t))
        sets.setdefault(i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and find(x) != find(y):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 2000), (3, 90, 12), (5, 80, 2000)])
def test_ngram_join(spark, docs, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng, rows = random.Random(5), [(i, t) for i, t, _ in texts(docs) if i is not None]
    vocabulary = [f"w{k}" for k in range(3000)]
    for family in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 14, 21, 40, 200, 500]))]
        for copy in range(25):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((10**6 + family * 100 + copy, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == plain_components(rows, n, percent)


def test_ngram_join_edges(docs):
    out = ngram_join.similar_components(docs)
    assert out.count() == docs.count() and out.where("doc_id IS NULL AND component_id IS NOT NULL AND n_shingles = 0").count() == 0
    assert ngram_join.similar_components(docs.limit(0)).count() == 0
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and left.count() <= docs.count()


def test_t_occurrence_merge():
    rng = random.Random(3)
    for _ in range(60):
        lists = [np.array(sorted(rng.sample(range(60), rng.randint(0, 30)))) for _ in range(8)]
        for least in (1, 2, 4):
            count = {x: sum(x in set(y.tolist()) for y in lists) for x in range(60)}
            assert ngram_join.merge_short(lists, least) == [(x, c) for x, c in count.items() if c >= least]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 3), (3, 5), (70, 71)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 3, 9: 3, 3: 3, 70: 70, 71: 70}


def test_mixing(docs):
    out = [(r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in mixing.mix_report(docs).collect()]
    assert sorted(out, key=str) == sorted(((r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in mixing.mix_report(docs.repartition(7)).collect()), key=str)
    sizes = {}
    for _, t, s in texts(docs):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if weight[s] * level > 2 * sizes[s]} - capped
        if not more:
            break
        capped |= more
    target = {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
    assert sorted({round(r[3], 6) for r in out}) == sorted({round(x, 6) for x in target.values()})
    assert all(0 <= r[5] <= 2 * r[1] and r[1] * r[4] == r[5] for r in out)
    by_target = {}
    for r in out:
        taken, largest = by_target.get((r[2], r[3]), (0, 0))
        by_target[r[2], r[3]] = taken + r[5], max(largest, r[1])
    assert all(abs(taken - t) <= largest / 2 + 1 for (_, t), (taken, largest) in by_target.items())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[4] for r in out) and mixing.mixed(docs.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    for r in quality_rules.measure(docs).collect():
        t = next(t for i, t, _ in texts_of(docs) if i == r.doc_id)
        if r.doc_id is None:
            continue
        w = words(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {x for x, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, x in enumerate(windows) if x in often for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.n_repeat_words == len(covered)
    clean = quality_rules.clean_documents(docs)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count() and quality_rules.clean_documents(docs.limit(0)).count() == 0
    junk = spark.createDataFrame([(1, "\n".join(["a | b | c | d | e | f | g | h"] * 3 + [f"W{k} is a plain word of a sentence." for k in range(3)])), (2, " ".join(f"Word{k}" for k in range(80)) + ".")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.measure(junk).collect()} == {1: False, 2: True}


_memo = {}


def texts_of(docs):
    if "t" not in _memo:
        _memo["t"] = texts(docs)
    return _memo["t"]


def test_license_scan(spark, docs):
    mit = license_scan.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Some Body\n\n" + mit.replace(",", " ,").lower()), (2, mit + "\nand more"), (3, "Text here.\nReleased  under the MIT Licence"), (4, None), (4, None), (5, license_scan.KNOWN[2][1].replace("HOLDER OR", "OWNER OR"))]
    got = {r.doc_id: (r.license_id, r.n_license_lines, r.line_licenses) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 0, ""), 2: (None, 0, ""), 3: (None, 1, "MIT"), 4: (None, 0, ""), 5: ("BSD-2-Clause", 0, "")}
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(docs.limit(0)).count() == 0


def test_license_scan_knows_whole_texts(spark):
    """Entire texts of usual licences, wrapped anew, with and without title, appendix and copyright line."""
    rows = [json.loads(x) for x in pkgutil.get_data("fellscan.llm", "known_licenses.jsonl").decode().strip().split("\n")]
    want, docs = {}, []
    for r in rows:
        for k, (title, ending) in enumerate([(r["titles"][0], r["endings"][-1]), ("", r["endings"][0]), (r["titles"][0], r["endings"][0])]):
            want[len(docs)] = r["license_id"]
            body = "\n".join(textwrap.fill(p, 60 + 20 * k, break_long_words=False, break_on_hyphens=False) if "opyright" not in p else p for p in r["bodies"][0].split("\n\n"))
            docs.append((len(docs), f"{title}\n\nCopyright (c) 2021 Some Body\n\n{body}\n\n{ending}\n"))
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(want.values())
    bare = license_scan.KNOWN[0][1].split("\n", 1)[1]
    docs += [(-1, bare), (-2, bare + "\nbut not quite"), (-3, rows[0]["bodies"][0][:-200])]
    want |= {-1: "MIT", -2: None, -3: None}
    assert {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_cotraining_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = cotraining.train(docs, even).score(docs).join(odd, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    none = cotraining.train(docs, labels.limit(0)).score(docs)
    assert none.count() == docs.count() and {r.score for r in none.select("score").distinct().collect()} == {0.5}
    assert cotraining.train(docs, even).score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [4096, 7])
def test_ngram_join_of_shared_passages(spark, monkeypatch, rows):
    """Strangers that share most of their words, near copies of the threshold's similarity, and an id with two texts."""
    monkeypatch.setattr(ngram_join, "SEGMENT_DOCS", rows)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    docs = []
    for i in range(150):
        docs.append((i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(8, 60))])))
    docs += [(500 + i, docs[i][1] + " " + rng.choice(vocabulary)) for i in range(0, 150, 5)]
    one, other = (" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(2))
    frame = [*docs, (900, one), (900, other), (901, one + " x"), (902, other + " y")]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(spark.createDataFrame(frame, "doc_id long, text string"), 5, 80).collect()}
    want = plain_components(docs, 5, 80)
    assert {i: c for i, c in got.items() if i < 900} == {i: c for i, (_, c) in want.items()}
    assert {got[i] for i in (900, 901, 902)} == {900} and len(set(got.values())) > 50


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (5, 9), (300, 280), (20_000, 19_000), (40, 9000)]:
        pool = rng.integers(0, 2**63, 2 * (n + m)).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, n, False)), np.unique(rng.choice(pool, m, False))
        x, y = ngram_join.parity(a), ngram_join.parity(b)
        size = min(len(x), len(y))
        apart = np.bitwise_count(ngram_join._folded(x, size) ^ ngram_join._folded(y, size)).sum()
        assert apart <= len(np.setxor1d(a, b)) and (ngram_join._folded(x, len(x)).tobytes() == x)


def test_ngram_join_shuffles_signatures_once_and_few_bits(spark, monkeypatch):
    """Signatures are exploded for one table only, and a set's parity bits are at most two a shingle (256 at least)."""
    exploded, old, rng = [], ngram_join.landed, random.Random(4)

    def landed(df, name):
        if "explode(sigs" in df._jdf.queryExecution().optimizedPlan().toString():
            exploded.append(name)
        return old(df, name)

    monkeypatch.setattr(ngram_join, "landed", landed)
    base = [f"w{rng.randrange(5000)}" for _ in range(700)]
    rows = [(i, " ".join(base[i:] + [f"x{i}"])) for i in range(12)]
    assert {r.component_id for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()} == {0}
    assert exploded == ["join-members"]
    for n in (1, 300, 700, 5000):
        assert len(ngram_join.parity(np.arange(n, dtype=np.uint64))) * 8 <= max(256, 2 * n)


def test_dedup_finds_repeated_ids_without_a_shuffle_of_texts(spark):
    """Whatever Spark broadcasts by itself: few exceptions are sent to the rows, not the rows to them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_dedup.without_copies(spark.createDataFrame([(1, "a"), (2, "A"), (2, "a"), (2, "a"), (3, "b"), (None, "c")], "doc_id long, text string"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.select("doc_id").toPandas()["doc_id"].fillna(-1).astype(int))) == ["-1", "2", "3"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
