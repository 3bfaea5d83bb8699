"""Each operator against the library, a brute-force version or a round trip, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from mortise.llm import gif, hilbert, line_dedup, minhash, packing, piece_fst, quotes, simhash, token_counts, toxicity
from mortise.llm.buckets import bucket_links
from mortise.llm.graph import components

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word wörd " * 30_000
TEXTS = ["The quick brown fox jumps over the lazy dog.\nA second line, a little longer than that.", "The quick brown fox jumps over the lazy dog.\nA second line, a little longer than that.", None, "", " ", "\n\n", "a", "  two  spaces ", "Tab\tand ▁mark 漢字 🙂 <s> <|endoftext|>", LONG, "0123456789" * 9]
ROWS = [(i, t, "en" if i % 2 else None, f"src{i % 3}", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "", "en", "src0", 0), (3, "", "en", "src0", 0), (9, LONG, "de", "src1", 1)]
#: Extra columns whose names clash with those that operators make for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("_place", "_toxic", "shard", "fingerprint", "item", "bucket", "_doc", "_may", "number")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text_of(x):
    return x or ""


def key(row):
    return tuple((v is None, str(v)) for v in row)


def test_token_counts_are_the_librarys(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PIECES).where("doc_id is not null").collect())
    expected = sorted((i, len(text_of(t).encode()), n := len(sp.encode(text_of(t))), n > 4096) for i, t, *_ in ROWS if i is not None)
    assert got == expected
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_whole_tokens_on_random_texts():
    whole, r = token_counts.whole_tokens(PIECES), random.Random(1)
    assert whole.splits and whole.lines and len(whole.spaced) > 10_000
    for _ in range(3000):
        t = "".join(r.choice(" \n\t▁aé<s>0x1漢🙂\0thing") for _ in range(r.randint(0, 25)))
        assert whole.count(t) == len(whole.sp.encode(t)), repr(t)


def test_piece_transducer_is_the_library(spark, docs, empty):
    import sentencepiece

    sp, machine, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_fst.transducer(PIECES), random.Random(2)
    for _ in range(2000):
        t = "".join(r.choice(" \n\t▁aé<s>0x1漢🙂\0thingoueers") for _ in range(r.randint(0, 25)))
        assert machine.encode(t).tolist() == sp.encode(t), repr(t)
        if "▁" not in t:
            assert machine.decode(machine.encode(t)) == t
    rows = piece_fst.round_trip(docs, PIECES).collect()
    assert len(rows) == len(ROWS) and piece_fst.round_trip(empty, PIECES).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.doc_id is not None) == sorted((i, len(sp.encode(text_of(t)))) for i, t, *_ in ROWS if i is not None)
    encoded = piece_fst.encode(docs.where("doc_id < 8"), PIECES)
    assert sorted((r.doc_id, r.text) for r in piece_fst.decode(encoded, PIECES).collect()) == sorted((i, text_of(t)) for i, t, *_ in ROWS if i is not None and i < 8)


def test_pairs_join_as_merging_says():
    machine, r = piece_fst.transducer(PIECES), random.Random(3)
    ids = list(machine.steps)
    for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(20_000)):
        x, y = machine.pieces[a], machine.pieces[b]
        assert machine._joins(a, b) == (machine.merge(x + y) == [x, y]), (x, y)


def test_character_rules_are_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    r = random.Random(4)
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        proto = model.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True).serialized_model_proto())
        spec = proto.normalizer_spec
        pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), *((c, -3.0 - i / 8, 1) for i, c in enumerate("aekfiltwoÅ1ß")), ("fi", -1.5, 1), ("▁a", -2.5, 1), *((f"<0x{i:02X}>", -9.0, 6) for i in range(256))]
        whole = model.ModelProto(normalizer_spec=spec)
        whole.trainer_spec.model_type, whole.trainer_spec.byte_fallback = 1, True
        for p, s, t in pieces:
            whole.pieces.add(piece=p, score=s, type=t)
        library = sentencepiece.SentencePieceProcessor(model_proto=whole.SerializeToString())
        machine = piece_fst.PieceTransducer.of(pieces, False, normaliser=spec)
        for _ in range(1500):
            t = "".join(r.choice(["ﬁ", "Å", "Å", "①", "  ", "　", "\t", "ａ", "k", "e", "é", "漢", "ß", "A", "²", "½", "🙂", "fi", "l"]) for _ in range(r.randint(0, 12)))
            assert machine.encode(t).tolist() == library.encode(t), (rule, t)


def test_unigram_transducer_takes_the_best_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.2, 1), ("ba", -9.0, 1)]
    machine = piece_fst.PieceTransducer.of(pieces, merges=False)
    scores = {p: -s for p, s, t in pieces if t == 1}

    def best(t):
        if not t:
            return 0.0, ()
        return min(((c + best(t[len(p) :])[0], (p, *best(t[len(p) :])[1])) for p, c in scores.items() if t.startswith(p)), default=(1e9, ()))

    for t in map("".join, product("ab ", repeat=4)):
        marked = "▁" + t.replace(" ", "▁")
        assert [pieces[i][0] for i in machine.encode(t)] == list(best(marked)[1]), t
    assert machine.encode("xyb").tolist() == [1, 0, 3]


def test_toxicity_learns_and_leaves_clean_texts(spark, empty):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "the", "er", "ing", "on", "ti", "wh"]) for _ in range(r.randint(1, 4)))
    made = []
    for i in range(600):
        w = [word() for _ in range(120)]
        toxic = i % 5 == 0
        if toxic:
            for j in range(0, 120, 20):
                w[j] = r.choice(["zorkface", "blugrat"])
        made.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(1000, None), (1001, ""), (None, "the an")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in made] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == 603 and rows[1000].score == rows[1001].score < 0.5
    held = [(rows[i].predicted, k) for i, _, k in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in made)
    assert sum(p == k for p, k in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.keep_ordinary(docs.withColumn("_toxic", F.lit(True)), model).collect()}
    assert kept == {i for i, x in rows.items() if not x.predicted}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.score(empty, none).count() == 0


def test_minhash_against_exact_jaccard(spark, docs, empty):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    errors = []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9) * 10:
        a = [r.choice(words) for _ in range(500)]
        b = a[: int(500 * share)] + [r.choice(words) for _ in range(500 - int(500 * share))]
        x, y = minhash.shingle_hashes(" ".join(a)), minhash.shingle_hashes(" ".join(b))
        exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append(minhash.likeness(minhash.sketch(x), minhash.sketch(y)) - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert minhash.sketch(minhash.shingle_hashes("")) == b"" and len(minhash.sketch(minhash.shingle_hashes("one"))) == 256
    assert minhash.edit_fingerprints(empty).count() == 0


@pytest.mark.parametrize("parts", ["1", "5"])
def test_edited_texts_follow_descending_ids(spark, docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = minhash.edit_fingerprints(docs.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((i, text_of(t)) for i, t, *_ in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    expected = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        expected[i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == expected
    same = {r.doc_id: r.fingerprint for r in rows}
    assert same[0] == same[1] and same[2] == same[3] == ""


def textbook_lzw(samples, bits, reset):
    """A plain LZW encoder, as a check on the decoder."""
    clear, out, width = 1 << bits, [], bits + 1
    put = lambda c: out.extend((c >> i) & 1 for i in range(width))
    table, free = {(i,): i for i in range(clear)}, clear + 2
    put(clear)
    now = ()
    for x in samples:
        if now + (x,) in table:
            now += (x,)
            continue
        put(table[now])
        if free < 4096:
            table[now + (x,)] = free
            free += 1
            if free - 1 == 1 << width and width < 12:
                width += 1
        elif reset:
            put(clear)
            table, free, width = {(i,): i for i in range(clear)}, clear + 2, bits + 1
        now = (x,)
    if now:
        put(table[now])
        if free < 4096 and free == 1 << width and width < 12:
            width += 1
    put(clear + 1)
    return np.packbits(np.array(out, dtype=np.uint8), bitorder="little").tobytes()


def test_lzw_streams():
    r = random.Random(5)
    for bits, n, spread, reset in product((2, 3, 8), (1, 7, 900, 20_000), (1, 2, 255), (True, False)):
        samples = [r.randrange(min(spread, 1 << bits)) for _ in range(n)]
        assert gif.lzw_decode(textbook_lzw(samples, bits, reset), bits, n).tolist() == samples
    with pytest.raises(ValueError):
        gif.lzw_decode(gif.lzw_encode(bytes(10)), 8, 11)
    for n, spread in product((0, 1, 2, 300, 70_000), (1, 3, 256)):
        samples = [r.randrange(spread) for _ in range(n)]
        stream = gif.lzw_encode(bytes(samples))
        assert gif.lzw_decode(stream, 8, n).tolist() == samples
    assert len(gif.lzw_encode(bytes(70_000))) < 2000


def test_broken_gifs_are_rows(spark):
    import struct

    good = gif.store_bytes(bytes(range(256)))
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    size = good.index(b"\x21\xf9\x04") + 18
    bad = [good[:size] + bytes([x]) + good[size + 1 :] for x in (0, 1, 9, 200)]
    media = spark.createDataFrame([(1, good), (2, huge), *((3 + i, x) for i, x in enumerate(bad))], "k int, media binary")
    got = {r.k: r.broken for r in gif.frames_of(media, "media", "k").collect()}
    assert got[1] is None and got[2] == "the canvas is too large" and all(got[k] for k in range(3, 7)) and gif.frames_of(media.limit(0), "media", "k").count() == 0


def image(left, top, w, h, samples, control=b"", flags=0, palette=b""):
    import struct

    return control + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + palette + b"\x02" + gif._blocks(textbook_lzw(samples, 2, True))


def control(disposal, delay, clear=None):
    import struct

    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)


def test_gif_disposal_transparency_and_palettes(spark):
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    data = head + b"".join((
        image(0, 0, 2, 2, [1, 1, 1, 1], control(1, 5)),
        image(0, 0, 1, 1, [2], control(3, 7)),  # afterwards the canvas is as before
        image(1, 1, 1, 1, [3], control(2, 1)),  # afterwards its area is clear
        image(0, 0, 2, 1, [0, 2], control(0, 2, clear=0)),
        image(0, 0, 1, 2, [0, 0], control(0, 0), 0x80, bytes([9, 9, 9, 8, 8, 8])),
    )) + b"\x3b"
    frames = gif.decode_gif(data)
    assert [f.rgba.tolist() for f in frames[:4]] == [[[red, red], [red, red]], [[green, red], [red, red]], [[red, red], [red, blue]], [[red, green], [red, none]]]
    assert frames[4].rgba[:, 0].tolist() == [[9, 9, 9, 255]] * 2
    assert [(f.start_ms, f.duration_ms) for f in frames[:4]] == [(0, 50), (50, 70), (120, 10), (130, 20)]
    tall = head[:6] + struct.pack("<HHBBB", 1, 9, 0x81, 0, 0) + palette + image(0, 0, 1, 9, [0, 2, 1, 2, 3, 3, 3, 3, 3], b"", 0x40) + b"\x3b"
    assert gif.decode_gif(tall)[0].rgba[:, 0, :3].argmax(axis=1).tolist() == [0, 2, 1, 2, 0, 2, 2, 2, 1]
    media = spark.createDataFrame([(1, data), (2, b"junk"), (3, None), (4, data[:40])], "k int, media binary")
    rows = gif.frames_of(media, "media", "k").collect()
    assert Counter(r.k for r in rows) == {1: 5, 2: 1, 3: 1, 4: 1} and sum(r.histogram[48] for r in rows if r.frame == 0) == 4
    assert {r.k for r in rows if r.broken} == {2, 3, 4}


def test_text_media_round_trip(docs, empty):
    rows = gif.media_features(docs).collect()
    expected = Counter()
    for i, t, *_ in ROWS:
        raw = text_of(t).encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        expected[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == expected
    # Grey values show as one histogram bin for each quarter of the range; the stored form is what a second storing gives.
    for i, t, *_ in ROWS:
        full = gif.padded(text_of(t).encode())
        counts, media = [0] * gif.BINS, gif.store_bytes(full)
        for v in full:
            counts[21 * (v >> 6)] += 1
        x = next(r for r in rows if r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.n_bytes == len(text_of(t).encode()))
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert len(full) > gif.ROW * gif.ROWS or x.feature == ",".join(map(str, counts))
    assert gif.media_features(empty).count() == 0


def test_hilbert_curve_steps_to_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        names = [f"c{i}" for i in range(dims)]
        df = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), names).select(*names, *(F.col(c).alias(f"k{c}") for c in names))
        rows = sorted(hilbert.hilbert_index(df, names, "at", bits).collect(), key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(1 << bits * dims))
        assert all(sum(abs(a[f"k{c}"] - b[f"k{c}"]) for c in names) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards_are_even(spark, docs, empty, tmp_path):
    rows = hilbert.shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(text_of(t).encode()) + 1, zlib.crc32(text_of(t).encode())) for i, t, *_ in ROWS)
    big = hilbert.shards(spark.range(1000).selectExpr("id % 700 as doc_id", "repeat('x', cast(id % 50 as int)) as text", "'s' as source", "'en' as lang")).collect()
    for got in (rows, big):
        of = defaultdict(list)
        for r in got:
            of[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in of.values())
        counts = [len(of.get(i, ())) for i in range(16)]
        assert max(counts) - min(counts) <= 1
    assert hilbert.shards(empty).count() == 0
    hilbert.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "_shard"]) and Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


def brute_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = {(i, text_of(t)): brute_simhash(text_of(t)) for i, t, *_ in ROWS}
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((i, f"{prints[i, text_of(t)]:016x}") for i, t, *_ in ROWS)
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {2} and simhash.near_duplicates(empty).count() == 0
    assert sorted(key(r) for r in simhash.one_of_each(docs).select("doc_id").collect()) == sorted(key((x,)) for x in {r.component_id for r in rows})


@pytest.mark.parametrize("chunk", [3, 2048])
def test_fingerprint_links_in_any_bucket_size(spark, monkeypatch, chunk):
    r = random.Random(7)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(40)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from mortise.llm import buckets

    monkeypatch.setattr(simhash, "bucket_links", lambda rows, linker: buckets.bucket_links(rows, linker, chunk))
    got = {r.fingerprint: r.component_id for r in simhash.fingerprint_components(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fingerprint long")).collect()}
    low = list(range(len(values)))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if bin(values[a] ^ values[b]).count("1") <= 3:
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    assert got == {s: find(i) for i, s in enumerate(signed)}


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucket_links_are_a_star(spark):
    rows = spark.createDataFrame([(1, i, bytes([i // 10])) for i in range(30)] + [(2, 99, b"x")], "bucket long, item long, payload binary")
    same = lambda p: lambda i, others: np.array([j for j in others if p[j] == p[i]], dtype=int)
    assert {(r.a, r.b) for r in bucket_links(rows, same).collect()} == {(i // 10 * 10, i) for i in range(30) if i % 10}


def test_line_dedup_against_brute_force(spark, docs, empty):
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "winter"]
    base = [" ".join(r.choice(words) for _ in range(20)) for _ in range(30)]
    made = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(base).split()
            if r.random() < 0.5:
                x[r.randrange(20)] = f"new{r.randrange(1000)}"
            lines.append(r.choice([" ".join(x), " ".join(x).upper(), "", "Les."]))
        made.append((i, "\n".join(lines)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table).collect()}
    lines = list(dict.fromkeys(n for _, t in made for x in t.split("\n") if (n := line_dedup.normal(x))))
    grams = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    low = list(range(len(lines)))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a in range(len(lines)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    at, seen, expected = {x: i for i, x in enumerate(lines)}, set(), {}
    for i, t in made:
        kept = []
        for x in t.split("\n"):
            n = line_dedup.normal(x)
            root = find(at[n]) if n else None
            if root is None or root not in seen:
                kept.append(x)
            if root is not None:
                seen.add(root)
        expected[i] = "\n".join(kept)
    assert got == expected
    clash = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(7)), counts=True)
    assert clash.columns[-3:] == ["n_lines", "_n_lines", "n_dropped"] and {r.n_lines for r in clash.collect()} == {7}
    odd = line_dedup.dedup_lines(docs)
    assert odd.columns == docs.columns and odd.count() == len(ROWS)
    by = {r.doc_id: r.text for r in odd.collect()}
    assert by[0] == TEXTS[0] and by[1] == "" and by[2] is None and by[5] == "\n\n"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_packing_holds_each_id_once(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES, keep_ids=True).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
        windows[r.sequence_id].append((r.offset, r.length))
    whole = Counter()
    for (doc, n), parts in pieces.items():
        copies = Counter(s for s, _ in parts)[0]
        ids = b"".join(x for s, x in sorted(parts)) if copies == 1 else None
        whole[doc, n] += copies
        if ids is not None and doc is not None:
            text = next(text_of(t) for i, t, *_ in ROWS if i == doc)
            assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert sum(whole.values()) == len(ROWS)
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(empty, BYTES).count() == 0
    full = packing.sequences(packing.pack(docs, BYTES, keep_ids=True)).collect()
    assert all(len(r.ids) == 4 * (r.n_tokens if bin(r.n_tokens).count("1") == 1 else 2048) for r in full)


def test_sum_of_squares_takes_the_least_sum():
    r, size = random.Random(9), 12
    packer, levels = packing.SumOfSquares(size), []
    for _ in range(400):
        n = r.randint(1, size)
        counts = Counter(x for x in levels if x < size)
        total = lambda c: sum(v * v for v in c.values())

        def after(level):
            c = Counter(counts)
            if level:
                c[level] -= 1
            if level + n < size:
                c[level + n] += 1
            return total(c)

        choices = {h: after(h) for h in {0, *counts} if h + n <= size}
        window, offset = packer.place(n)
        assert choices[offset] == min(choices.values())
        if offset:
            assert levels[window] == offset
            levels[window] += n
        else:
            assert window == len(levels)
            levels.append(n)


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(BYTES), packing.byte_bpe(BYTES), random.Random(10)
    assert own.encoder is not None
    for _ in range(2000):
        t = "".join(r.choice(["a", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "12", "漢", " ", "\u0085", "thing", "!?"]) for _ in range(r.randint(0, 12)))
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_quotations_link_replies(spark):
    mail = [
        (1, 0, "user", "Shall we meet on Monday?\n\nThe room is free all day."),
        (1, 1, "assistant", "On Sunday Ann wrote:\n> Shall we meet on Monday?\nYes, at ten."),
        (1, 2, "user", "> The room is free\n> all day.\n\nThen let us book it."),
        (1, 3, "user", ">> Shall we meet on Monday?\n> Yes, at ten.\nFine with me."),
        (1, 4, "user", "Something else."),
        (2, 0, "user", "> Shall we meet on Monday?\nNo original here."),
        (2, 1, None, None),
        (None, 0, "user", "> x\ny"),
        (1, 4, "user", "Something else."),
    ]
    rows = quotes.link_quotations(spark.createDataFrame(mail, "conv_id long, turn long, role string, text string").withColumn("units", F.lit(1))).collect()
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.thread) for r in rows}
    assert len(rows) == len(mail)
    assert got[1, 1] == ("Yes, at ten.", 0, 0) and got[1, 2] == ("Then let us book it.", 0, 0) and got[1, 3] == ("Fine with me.", 1, 0)
    assert got[1, 4] == ("Something else.", None, 4) and got[2, 0][1:] == (None, 0) and got[2, 1] == ("", None, 1)
    far = quotes.link_quotations(spark.createDataFrame([*mail, (3, 0, "user", "He wrote:\n> The room is free\n> all day. The\n> rest was cut\nGood."), (3, 1, "user", "> Good.\nYes.")], "conv_id long, turn long, role string, text string"), elsewhere_words=5).collect()
    away = {(r.conv_id, r.turn): (r.reply_conv, r.reply_to, r.thread_conv, r.thread) for r in far}
    assert away[3, 0] == (1, 0, 1, 0) and away[3, 1] == (3, 0, 1, 0) and away[2, 0] == (1, 0, 1, 0) and away[1, 3] == (1, 1, 1, 0)
    ordered = quotes.conversations(quotes.link_quotations(spark.createDataFrame(mail[:5], "conv_id long, turn long, role string, text string"))).collect()
    assert [r.turn for r in ordered] == [0, 1, 2, 3, 4]
    assert quotes.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
