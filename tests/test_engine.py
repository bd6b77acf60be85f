"""Decoder vectors and brute force, tiers, TextGrid, signals, network algebra, sources, streams."""

import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalign.operators import align, decode, evaluate, lookup, metrics, network, signal, tiers
from spanalign.sources import audio, model_file, phones, sinks, textgrid
from spanalign.streaming import watch


def placed(spark, spans, groups, end_ms=None):
    """Spans after ``preserve_skips``, as (onset, offset) in order."""
    rows = [(1, i, a, b, g, end_ms) for i, ((a, b), g) in enumerate(zip(spans, groups, strict=True))]
    df = spark.createDataFrame(rows, "clip_id int, n int, on_ms long, off_ms long, group_id int, end_ms long")
    got = tiers.preserve_skips(df, "clip_id", "n", "group_id", end=None if end_ms is None else "end_ms")
    assert got.schema == df.schema
    return [(r.on_ms, r.off_ms) for r in got.orderBy("n").collect()]


def diag(t, n):
    m = -np.ones((t, n))
    for i in range(n):
        m[t * i // n : t * (i + 1) // n, i] = 1
    return m


def skip_case():
    m = -np.ones((12, 3))
    m[:5, 0], m[7:, 2] = 1, 1
    return m


@pytest.mark.parametrize(
    "m,groups,p,spans,score",
    [
        (diag(20, 4), None, 0.5, [(0, 5), (5, 10), (10, 15), (15, 20)], 20),
        (skip_case(), None, 0.5, [(0, 5), (7, 7), (7, 12)], 9.5),
        (skip_case(), [1, 1, 2], 0.5, [(0, 5), (5, 5), (7, 12)], 9.5),
        (skip_case(), [1, 1, 1], 0.5, [(0, 5), (5, 6), (6, 12)], 8.0),
        (diag(10, 3), [1, 1, 2], 0.5, [(0, 3), (3, 6), (6, 10)], 10),
        (-np.ones((4, 3)), None, 0.5, [(4, 4)] * 3, -1.5),
        (np.zeros((4, 2)), None, 0.0, [(4, 4)] * 2, 0),
        (np.full((4, 2), 0.5), None, 0.5, [(0, 1), (1, 4)], 2.0),
        (-np.ones((3, 2)), None, 0.0, [(3, 3)] * 2, 0),
    ],
)
def test_decode_vectors(m, groups, p, spans, score):
    got, s = decode.decode(m, groups, p)
    assert (got, s) == (spans, pytest.approx(score))


def test_decode_bad_input():
    for args in ((np.zeros((0, 2)),), (np.zeros((2, 2)), None, -1.0), (np.zeros((2, 2)), [1])):
        with pytest.raises(ValueError):
            decode.decode(*args)


def best(m, p, free):
    t, n = m.shape
    top = -np.inf
    for cuts in itertools.combinations_with_replacement(range(t + 1), 2 * n):
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        used = [(a, b, i) for i, (a, b) in enumerate(spans) if a < b]
        edges = [(0, -1), *[(b, i) for _, b, i in used]]
        starts = [*[(a, i) for a, _, i in used], (t, n)]
        if all(e == s or free[i + 1 : j + 1].any() for (e, i), (s, j) in zip(edges, starts, strict=True)):
            top = max(top, sum(m[a:b, i].sum() for a, b, i in used) - p * (n - len(used)))
    return top


def test_decode_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        t, n = rng.integers(1, 5), rng.integers(1, 4)
        m = rng.integers(-8, 9, (t, n)) / 4
        groups = np.cumsum(rng.integers(0, 2, n)).tolist()
        spans, score = decode.decode(m, groups, 0.5)
        assert score == pytest.approx(best(m, 0.5, decode.boundaries(n, groups)))
        assert score == pytest.approx(sum(m[a:b, i].sum() for i, (a, b) in enumerate(spans)) - 0.5 * sum(a >= b for a, b in spans))
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(spans))


def test_tiers(spark):
    df = spark.createDataFrame([("c", 1, "ni", 0, 400), ("c", 2, "hao", 300, 800), ("c", 3, "x", 800, 800)], "k string, n long, text string, on_ms long, off_ms long")
    got = [(r.on_ms, r.off_ms) for r in tiers.clamp(df, "k", "n").orderBy("n").collect()]
    assert got == [(0, 400), (400, 800), (800, 801)]
    assert tiers.handle_skips(df, "k", "omit").count() == 2 and tiers.handle_skips(df, "k", "discard").count() == 0
    spans = spark.createDataFrame([("c", 500, 1000, "h"), ("c", 1500, 2000, "e")], "k string, on_ms long, off_ms long, text string")
    full = tiers.fill_gaps(spans, "k", spark.createDataFrame([("c", 2500)], "k string, end_ms long"), "SP").orderBy("on_ms").collect()
    assert [(r.on_ms, r.off_ms, r.text) for r in full] == [(0, 500, "SP"), (500, 1000, "h"), (1000, 1500, "SP"), (1500, 2000, "e"), (2000, 2500, "SP")]
    assert placed(spark, [(0, 500), (500, 500), (500, 1000)], [1, 2, 3]) == [(0, 500), (500, 501), (501, 1000)]


def test_owner_at(spark):
    iv = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 10, 20), ("c", 3, 30, 40)], "k string, ord long, on_ms long, off_ms long")
    pts = spark.createDataFrame([("c", x) for x in (0, 5, 10, 15, 25, 30, 99)] + [("d", 1)], "k string, at_ms long")
    got = {(r.k, r.at_ms): r.owner for r in lookup.owner_at(pts, iv, "k").collect()}
    assert got == {("c", 0): 1, ("c", 5): 1, ("c", 10): 1, ("c", 15): 2, ("c", 25): 2, ("c", 30): 3, ("c", 99): 3, ("d", 1): 1}


def test_text_grid_round_trip(spark, tmp_path):
    rows = [("c", 1, "words", 0, 500, 'a"b'), ("c", 1, "words", 500, 1250, ""), ("c", 2, "phones", 0, 1250, "x")]
    t = spark.createDataFrame(rows, "k string, tier_ord int, tier string, on_ms long, off_ms long, text string")
    files = textgrid.text_grids(t, spark.createDataFrame([("c", 1250)], "k string, end_ms long"), "k")
    content = files.first().content
    assert 'text = "a""b"' in content
    assert textgrid.parse(content) == [("words", 1, 0.0, 0.5, 'a"b'), ("words", 2, 0.5, 1.25, ""), ("phones", 1, 0.0, 1.25, "x")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.TextGrid").write_text(content)
    assert textgrid.read_intervals(spark, str(tmp_path / "in")).count() == 3
    sinks.write_text_grids(files, "k", str(tmp_path / "out"))


def wav(x, rate=44100):
    body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_audio_and_signals(spark, tmp_path):
    x = 0.3 * np.sin(2 * math.pi * 220 * np.arange(3 * 44100) / 44100)
    (tmp_path / "a.WAV").write_bytes(wav(x))
    (tmp_path / "b.mp3").write_bytes(b"?")
    got = {r.path[-5:]: r for r in audio.read_clips(spark, str(tmp_path)).collect()}
    assert got["a.WAV"].sample_rate == 44100 and len(got["a.WAV"].samples) == len(x) and got["b.mp3"[-5:]].error
    y = signal.resample(np.array(got["a.WAV"].samples), 44100, 48000)
    assert len(y) == 144000 and np.abs(y[5000:9000] - 0.3 * np.sin(2 * math.pi * 220 * np.arange(5000, 9000) / 48000)).max() < 5e-3
    mel = signal.log_mel(y)
    assert mel.shape == (300, 80) and abs(signal.mel_to_hz(signal.hz_to_mel([440.0, 3000.0])) - [440, 3000]).max() < 1e-6
    assert mel[100].argmax() == signal.mel_filters(48000, 2048, 80, 0, 8000)[:, round(220 * 2048 / 48000)].argmax()
    stream = watch.arriving_clips(spark, str(tmp_path))
    q = stream.writeStream.format("memory").queryName("clips").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("clips").count() == 2


def test_network_algebra():
    c = network.Config(dim=16, layers=2, heads=2, head_dim=8, ffn=12, conv=10, kernel=5, merge_kernel=3, mels=6, vocab=9, out=7)
    w = network.random_weights(c)
    rng = np.random.default_rng(1)
    out = network.forward(rng.normal(size=(11, 6)), np.array([1, 4, 2]), w, c)
    assert out["similarity"].shape == (11, 3) and np.abs(out["similarity"]).max() <= 1 + 1e-9
    x, k = rng.normal(size=(7, 3)), rng.normal(size=(3, 5))
    naive = [[sum(x[t + i - 2, j] * k[j, i] for i in range(5) if 0 <= t + i - 2 < 7) for j in range(3)] for t in range(7)]
    assert np.allclose(network.depthwise(x, k), naive)
    q = rng.normal(size=(9, 2, 4))
    assert np.allclose(network.attention(q, q, q, rows=2), network.attention(q, q, q, rows=100))
    assert np.allclose((network.rope(q, 1e4) ** 2).sum(-1), (q**2).sum(-1))


def test_phone_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,ph_seq\na,AP SP\nb, x  y \na,other\n")
    assert [(r.clip_id, r.n, r.label) for r in phones.read_transcriptions(spark, str(tmp_path / "t.csv")).orderBy("clip_id", "n").collect()] == [("a", 0, "AP"), ("a", 1, "SP"), ("b", 0, "x"), ("b", 1, "y")]
    (tmp_path / "v.json").write_text('{"symbols": {"AP": 1, "zh/a": 2}, "global_symbols": ["AP"], "stop_symbols": ["SP"]}')
    v = phones.read_vocabulary(spark, str(tmp_path / "v.json"))
    t = spark.createDataFrame([("zh", "a"), ("en", "a"), ("zh", "AP")], "lang string, symbol string")
    got = {(r.lang, r.symbol): r.token_id for r in lookup.resolve(t, v.select("symbol", "token_id"), ["AP"]).collect()}
    assert got == {("zh", "a"): 2, ("en", "a"): None, ("zh", "AP"): 1}


def test_queries_against_sql(spark):
    """Every query with SQL equals DuckDB's result at the smallest scale."""
    import os

    import duckdb

    from spanalign.plans.queries import oracle_sql, queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    for name, sql in oracle_sql().items():
        got = queries()[name](spark, d)
        rel = con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(rel.columns), name
        key = lambda r: tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r)
        left = sorted(key(r) for r in got.select(*cols).collect())
        right = sorted(key(r) for r in con.execute(f"select {', '.join(cols)} from ({sql})").fetchall())
        assert left == right, name
    assert queries()["flagship"](spark, d).filter(F.col("off_ms") <= F.col("on_ms")).count() == 0


def test_skips_are_placed_inside_their_gap(spark):
    skipped = [(0, 100), (300, 300), (300, 300), (300, 400)]
    assert placed(spark, skipped, [1, 1, 2, 3]) == [(0, 100), (100, 101), (299, 300), (300, 400)]
    assert placed(spark, skipped, [1, 2, 3, 4]) == [(0, 100), (298, 299), (299, 300), (300, 400)]
    assert placed(spark, [(0, 5), (5, 5), (5, 9)], [1, 1, 1]) == [(0, 5), (5, 6), (6, 9)]
    assert placed(spark, [(0, 5), (5, 5)], [1, 2], end_ms=20) == [(0, 5), (19, 20)]
    assert placed(spark, [(5, 5), (5, 9)], [1, 1]) == [(4, 5), (5, 9)]
    assert placed(spark, [], []) == []


def test_erf_and_bounded_resampling():
    x = np.linspace(-8, 8, 4001)
    assert np.abs(network.erf(x) - [math.erf(v) for v in x]).max() < 1e-10
    tone = np.sin(np.arange(70000) / 20)
    up = signal.resample(tone, 24000, 48000)
    assert len(up) == 140000 and np.abs(up[1000:-1000] - np.sin(np.arange(140000) / 40)[1000:-1000]).max() < 2e-3


SMALL = network.Config(dim=32, layers=1, heads=2, head_dim=8, ffn=32, conv=32, kernel=5, merge_kernel=3, mels=80, vocab=6, out=32)
VOCABULARY = '{"symbols": {"SP": 0, "zh/a": 1, "b": 2, "zh/c": 4}, "global_symbols": ["SP"], "stop_symbols": ["SP"]}'
ABOUT = {"general.architecture": "x", "m.vocab.json": VOCABULARY, "m.model.in_dim": 80, "m.model.max_vocab_size": 6, "m.model.out_dim": 32, "m.backbone.dim": 32, "m.backbone.num_layers": 1, "m.backbone.num_heads": 2, "m.backbone.head_dim": 8}


def test_model_file_round_trip(spark, tmp_path):
    names = model_file.names_in_file(SMALL)
    weights = {k: v.astype(np.float32) for k, v in network.random_weights(SMALL).items()}
    for kind, far in (("F32", 0), ("F16", 2e-3), ("Q8_0", 2e-2), ("Q4_0", 0.3)):
        data = model_file.dump(ABOUT, {names[k]: v for k, v in weights.items()}, lambda name, x, kind=kind: kind if x.ndim == 2 and ".dw" not in name else "F32")
        m = model_file.parse(data)
        assert model_file.config_of("m", m).dim == 32 and model_file.vocabulary_of("m", m)["names"] == ["SP", "zh/a", "b", "<unused>", "zh/c"]
        got = model_file.weights_of(m, SMALL)
        assert set(got) == set(weights) and all(np.abs(got[k] - v).max() <= far * max(1, np.abs(v).max()) for k, v in weights.items())
    (tmp_path / "m.bin").write_bytes(data)
    m = model_file.read_model(spark, str(tmp_path / "m.bin"), tensors=False)
    assert not m.tensors and model_file.inspect(spark, "m", m).first().kinds == "F16,F32,Q4_0"
    for bad, why in ((b"XXXX", "no model"), (data[:100], "early"), (data[:-500], "beyond")):
        with pytest.raises(model_file.ModelFileError, match=why):
            model_file.parse(bad)
    m = model_file.parse(data)
    del m.tensors["token_embedding.weight"]
    with pytest.raises(model_file.ModelFileError, match="token_embedding"):
        model_file.weights_of(m, SMALL)
    with pytest.raises(model_file.ModelFileError):
        m.get("m.backbone.dim", str)


def test_super_blocks_expand_as_their_layout_says():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, (3, 176), np.uint8)
    raw[:, :4] = np.array([0.5, 0.25], "<f2").view(np.uint8)
    got = model_file.expand(raw, "Q5_K")
    for b in range(3):
        for i in range(256):
            j = i // 32
            s = raw[b, 4:16].astype(int)
            scale, least = (s[j] & 63, s[j + 4] & 63) if j < 4 else (s[j + 4] & 15 | s[j - 4] >> 6 << 4, s[j + 4] >> 4 | s[j] >> 6 << 4)
            four = int(raw[b, 48 + j // 2 * 32 + i % 32]) >> 4 * (j % 2) & 15
            q = four + 16 * (int(raw[b, 16 + i % 32]) >> j & 1)
            assert got[b, i] == pytest.approx(0.5 * scale * q - 0.25 * least)
    raw = rng.integers(0, 256, (2, 210), np.uint8)
    raw[:, 208:] = np.array([0.125], "<f2").view(np.uint8)
    got = model_file.expand(raw, "Q6_K")
    for b in range(2):
        for i in range(256):
            half, quarter, at = i // 128, i % 128 // 32, i % 32
            four = int(raw[b, 64 * half + 32 * (quarter % 2) + at]) >> 4 * (quarter // 2) & 15
            two = int(raw[b, 128 + 32 * half + at]) >> 2 * quarter & 3
            assert got[b, i] == pytest.approx(0.125 * int(raw[b, 192 + i // 16].view(np.int8)) * (four + 16 * two - 32))


def test_alignment_from_waveforms_to_files(spark):
    rng = np.random.default_rng(2)
    wave = [float(x) for x in rng.normal(0, 0.1, 24000)]
    clips = spark.createDataFrame([("u", 24000, wave), ("v", 24000, wave[:9600]), ("w", 24000, wave[:20]), ("x", 24000, wave)], "clip_id string, sample_rate int, samples array<float>")
    labels = spark.createDataFrame([(k, i, s, "zh") for k, seq in (("u", "SP a b c"), ("v", "b a"), ("w", "a"), ("x", "a ?")) for i, s in enumerate(seq.split())], "clip_id string, n int, label string, lang string")
    vocabulary = model_file.vocabulary_of("m", model_file.ModelFile({"m.vocab.json": VOCABULARY}))
    encoded = align.encode(labels, align.vocabulary_table(spark, vocabulary), vocabulary["global_symbols"], vocabulary["stop_symbols"]).cache()
    ids = {r.clip_id: (r.ids, r.error) for r in encoded.collect()}
    assert ids["u"] == ([1, 2, 4], None) and ids["x"][1] == "unknown label ?"
    aligned = align.align_clips(clips.join(encoded, "clip_id"), network.random_weights(SMALL), SMALL).cache()
    rows = {r.clip_id: r for r in aligned.collect()}
    assert rows["u"].num_frames == 100 and len(rows["u"].spans) == 3 and rows["u"].error is None and 0 < rows["u"].agreement < 1
    assert "padding" in rows["w"].error and rows["x"].error == "unknown label ?"
    for skips in ("omit", "preserve"):
        parts, ends = align.build_tiers(align.span_rows(aligned, encoded), skips)
        files = {r.clip_id: r.content for r in textgrid.text_grids(parts, ends, "clip_id").collect()}
        assert set(files) <= {"u", "v"} and "u" in files
        for content in files.values():
            back = textgrid.parse(content)
            assert [t for t, *_ in back][0] == "texts" and {t for t, *_ in back} == {"texts", "words", "phones"}
            for tier in ("texts", "words", "phones"):
                edges = [(a, b) for t, _, a, b, _ in back if t == tier]
                assert edges[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(edges))


def test_measures_equal_the_table_form(spark):
    rng = np.random.default_rng(3)
    sims = rng.uniform(-1, 1, (30, 9))
    spans, _ = decode.decode(sims, None, 0.5)
    cells = spark.createDataFrame([("k", t, n, float(sims[t, n])) for t in range(30) for n in range(9)], "clip_id string, t long, n int, s double")
    table = spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate(spans)], "clip_id string, n int, on_f int, off_f int")
    got = align.measures(sims, spans)
    for name in ("confidence", "determinacy", "monotonicity"):
        assert getattr(metrics, name)(cells, table).first()[1] == pytest.approx(got[name], abs=1e-9), name


def test_owners_are_inherited_from_a_first_pass(spark):
    tier = lambda name, *rows: [("k", name, i + 1, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)]
    rows = tier("texts", (0, 1, ""), (1, 3, "good day"), (3, 5, "end")) + tier("words", (0, 1, ""), (1, 2, "good"), (2, 3, "day"), (3, 4, ""), (4, 5, "end"))
    rows += tier("phones", (0, 1, "SP"), (1, 1.5, "g"), (1.5, 2, "u"), (2, 3, "d"), (3, 4, "SP"), (4, 5, "e")) + [("other", "phones", 1, 0.0, 1.0, "a")]
    got = align.inherit_owners(spark.createDataFrame(rows, "clip_id string, tier string, ord int, xmin double, xmax double, text string"), ["SP"]).orderBy("n").collect()
    assert [tuple(r) for r in got] == [("k", 0, "g", 1, 1, "good day", "good"), ("k", 1, "u", 1, 1, "good day", "good"), ("k", 2, "d", 1, 2, "good day", "day"), ("k", 3, "e", 2, 3, "end", "end")]


def test_preserved_skips_keep_order_and_width(spark):
    import random

    rng = random.Random(8)
    rows = []
    for clip in range(200):
        t = 0
        for n in range(rng.randint(1, 9)):
            on = t + rng.choice([0, 0, 2, 7])
            off = on + rng.choice([0, 0, 1, 6])
            rows.append((clip, n, on, off, n // 2))
            t = off
    df = spark.createDataFrame(rows, "clip_id int, n int, on_ms long, off_ms long, group_id int")
    got = {}
    for r in tiers.preserve_skips(df, "clip_id", "n", "group_id").orderBy("clip_id", "n").collect():
        got.setdefault(r.clip_id, []).append(r)
    was = {(c, n): (a, b) for c, n, a, b, _ in rows}
    for clip, spans in got.items():
        assert len(spans) == sum(c == clip for c, *_ in rows)
        assert all(x.off_ms <= y.on_ms for x, y in zip(spans, spans[1:], strict=False)) and all(x.off_ms > x.on_ms for x in spans)
        for x in spans:
            on, off = was[clip, x.n]
            assert x.off_ms - x.on_ms == 1 if on == off else x.on_ms >= on and x.off_ms >= off


def test_anchor_skipped_by_definition():
    import random

    rng = random.Random(9)
    for _ in range(2000):
        n, frames, t, spans = rng.randint(1, 6), 8, 0, []
        for _ in range(n):
            a = min(frames, t + rng.randint(0, 1))
            t = min(frames, a + rng.choice([0, 0, 1, 2]))
            spans.append([a, t])
        free = np.array([True, *(rng.random() < 0.4 for _ in range(n - 1)), True])
        got = decode.anchor_skipped([list(x) for x in spans], frames, free)
        for i, (a, b) in enumerate(spans):
            lefts = [j for j in range(i) if spans[j][0] < spans[j][1]]
            rights = [j for j in range(i + 1, n) if spans[j][0] < spans[j][1]]
            start = lefts[-1] + 1 if lefts else 0
            if a < b:
                assert got[i] == (a, b)
            elif free[start : i + 1].any():
                assert got[i] == ((spans[rights[0]][0] if rights else frames),) * 2
            else:
                assert got[i] == ((spans[lefts[-1]][1] if lefts else 0),) * 2


def test_run_difference_and_summary(spark):
    kind = "k string, ord int, on_ms long, off_ms long, text string"
    ref = spark.createDataFrame([("a", 0, 0, 5, "x"), ("a", 1, 5, 9, "y"), ("b", 0, 0, 4, "z"), ("c", 0, 1, 2, "w"), ("d", 0, 0, 1, "v")], kind)
    other = spark.createDataFrame([("a", 0, 0, 5, "x"), ("a", 1, 5, 9, "y"), ("b", 0, 0, 6, "q"), ("d", 0, 0, 1, "v"), ("d", 1, 1, 2, "u"), ("e", 0, 0, 1, "n")], kind)
    got = {r.k: tuple(r)[1:] for r in evaluate.run_difference(ref, other, "k").collect()}
    assert got == {"a": (2, 2, True, 0, 0.0, 0), "b": (1, 1, False, 2, 1.0, 1), "c": (1, 0, False, 0, 0.0, 0), "d": (1, 2, False, 0, 0.0, 0)}
    rng = np.random.default_rng(4)
    values = rng.integers(0, 20_000, 997)
    pairs = spark.createDataFrame([("a", int(v), int(v // 2), True) for v in values], "k string, d_on long, d_off long, same boolean")
    s = evaluate.summary(pairs, [20]).first()
    assert (s.on_p90, s.off_p90) == (sorted(values)[int(0.9 * 997)], sorted(values // 2)[int(0.9 * 997)]) and s.on_median == np.median(values)


def test_sinks_and_lookups(spark, tmp_path):
    files = spark.createDataFrame([("a b", 'x = "1"\nend\n'), ("dir/c=d", "two\n")], "k string, content string")
    sinks.write_text_grids(files, "k", str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.TextGrid")) == ["a b.TextGrid", "dir/c=d.TextGrid"]
    assert (tmp_path / "out" / "a b.TextGrid").read_text() == 'x = "1"\nend\n' and not list((tmp_path / "out").glob("_staged*"))
    errors = spark.createDataFrame([("b", 2, 1.23456), ("a", 1, 0.0)], "k string, n long, mae double")
    sinks.write_evaluation(errors, "k", str(tmp_path / "csv"))
    lines = [x for p in sorted((tmp_path / "csv").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x for x in lines if not x.startswith("identifier")] == ["a,1,0.000", "b,2,1.235"]
    clips = spark.createDataFrame([("a", None), ("b", "too long"), ("c", None)], "path string, error string")
    assert {tuple(r) for r in sinks.run_summary(clips).collect()} == {("ok", 2), ("skipped", 1)}
    vocab = spark.createDataFrame([("en/a", 1), ("a", 2), ("fr/b", 3)], "symbol string, token_id int")
    got = lookup.resolve_any(spark.createDataFrame([("a",), ("b",), ("z",)], "symbol string"), vocab, ["fr", "en"]).collect()
    assert {r.symbol: r.token_id for r in got} == {"a": 1, "b": 3, "z": -1}
    grids = spark.createDataFrame([("/g/one.TextGrid", "t")], "path string, text string")
    paths = spark.createDataFrame([("/w/one.wav",), ("/w/two.wav",)], "path string")
    assert {r.path: r.grid_text for r in lookup.by_stem(paths, grids).collect()} == {"/w/one.wav": "t", "/w/two.wav": None}
    marked = spark.createDataFrame([("SP",), ("a",), (None,)], "text string")
    assert sorted(r.text or "" for r in evaluate.without_marks(marked, ["SP", "AP"]).collect()) == ["", "a"]
    textgrid.register(spark)
    spark.createDataFrame([('item [1]:\nname = "phones"\nintervals [1]:\nxmin = 0.5s\nxmax = bad\ntext = "h"',)], "c string").createOrReplaceTempView("grid_files")
    assert [tuple(r) for r in spark.sql("select i.* from grid_files, lateral textgrid_intervals(c, 'phones') i").collect()] == [(1, 0.5, 0.0, "h")]
    sinks.write_diagnosis(spark.createDataFrame([('q"', 3, 2, 0.5, 0.5, 0.5, 0.5)], "identifier string, num_frames int, num_tokens int, agreement double, confidence double, determinacy double, monotonicity double"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().identifier == 'q"'
