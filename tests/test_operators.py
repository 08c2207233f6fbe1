import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.functions import dims
from pagelight.operators import history as H
from pagelight.operators import image as I
from pagelight.operators import interaction as N
from pagelight.operators import kernels as K
from pagelight.operators import recognition as R
from pagelight.plans import recognition as P
from pagelight.sources import folders


def test_reconstruct_keeps_input_order(spark):
    words = [(1, 1, 1, 1, 2, "world"), (1, 1, 1, 1, 1, "Hello"), (1, 1, 1, 2, 3, " again "), (1, 1, 2, 1, 4, "Par"), (1, 2, 1, 1, 5, "Block"), (1, 10, 1, 1, 6, "ten"), (1, 1, 1, 1, 7, "  ")]
    df = spark.createDataFrame(words, "page_id int, block_num int, par_num int, line_num int, ord int, text string")
    assert R.reconstruct(df, "page_id").first().text == "Hello world\nagain\n\nPar\n\nBlock\n\nten"


def score(spark, text, confs, target="eng", height=12):
    words = [(1, t, float(c), height) for t, c in zip(text.split(), confs, strict=False)]
    page = spark.createDataFrame([(1, text)], "page_id int, text string")
    conf = R.word_confidence(spark.createDataFrame(words, "page_id int, text string, conf double, height int"), "page_id")
    return R.scored(page, conf, "page_id", target).first()


def test_scores(spark):
    clean = score(spark, "The lamp shone over the quiet harbour until dawn came again", [95] * 11)
    assert clean.composite_score > 70 and clean.symbol_penalty == 0
    noise = score(spark, "$$$$ ~~~~ ^^^^ ####", [5] * 4)
    assert noise.composite_score < 30 and noise.symbol_penalty > 0.5
    empty = R.scored(spark.createDataFrame([(1, " ")], "page_id int, text string"), spark.createDataFrame([], "page_id int, n_valid long, avg_conf double, high_share double, n_heights long, h1 long, h2 long"), "page_id").first()
    assert empty.composite_score == 0 and empty.symbol_penalty == 1 and empty.total_words == 0
    tamil = "தமிழ் ஒரு மிகத் தொன்மையான மொழி"
    assert score(spark, tamil, [90] * 5, "tam+eng").composite_score > score(spark, tamil, [90] * 5, "hin").composite_score


def test_search_order_and_ties(spark):
    rows = [(1, 1, "a", 50.0), (1, 2, "b", 85.0), (1, 3, "c", 99.0), (2, 1, "a", 39.99), (2, 2, "b", 39.99), (3, 1, "a", 40.0)]
    cands = spark.createDataFrame(rows, "page_id int, ord int, variant string, score double")
    tried = R.evaluated(cands, "page_id")
    assert sorted((r.page_id, r.ord) for r in tried.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page_id int")
    fallback = spark.createDataFrame([(p, 9, "f", 10.0) for p in (1, 2, 3, 4)], cands.schema)
    every = R.with_fallback(tried, fallback, pages, "page_id")
    assert sorted(r.page_id for r in every.filter("variant = 'f'").collect()) == [2, 4]
    assert {r.page_id: r.variant for r in R.best(every, "page_id").collect()} == {1: "b", 2: "a", 3: "a", 4: "f"}


def test_stability_equals_a_fold(spark):
    rng = random.Random(4)
    rows, want, count, last = [], [], 0, None
    for i in range(200):
        found, x = rng.random() > 0.1, rng.choice([0.0, 0.0, 5.0, 60.0, 200.0])
        area = rng.choice([0.5, 0.5, 0.5, 0.1])
        rows.append((1, i, found, area, 640, 480, *[x] * 8))
        if not found or area < 0.15:
            count, last = 0, None
        else:
            moved = 0.0 if last is None else np.hypot(x - last, x - last) / np.hypot(640, 480)
            count = 1 if last is None else count + 1 if moved <= 0.03 else max(0, count - 1)
            last = x
        want.append((i, count))
    names = ", ".join(f"{a}{i} double" for i in range(1, 5) for a in "xy")
    df = spark.createDataFrame(rows, f"d int, n int, found boolean, area_ratio double, width int, height int, {names}")
    got = N.stability(df, "d", ["n"])
    assert sorted((r.n, r.stable_count) for r in got.collect()) == want
    assert all((r.status == "PAGE_STABLE") == (r.stable_count >= 4) for r in got.collect())


def test_states(spark):
    path = ["WAIT_WAKE_WORD", "ASK_PREFERENCES", "WAIT_START", "ALIGNING_PAGE", "PROCESSING_PAGE", "READING", "READING", "WAIT_START", "PAGE_FINISHED"]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(path)], "s string, i int, requested string")
    got = N.replay(df, "s", ["i"], "requested").orderBy("i").collect()
    assert [r.accepted for r in got] == [True] * 7 + [False, True]
    assert [r.notified for r in got] == [True] * 6 + [False, False, True]
    assert got[7].to_state == "READING"


def test_power_press_before_the_wake_word_is_refused(spark):
    df = spark.createDataFrame([("s", 0, "B:POWER_PRESS"), ("s", 1, "V:START_READING"), ("s", 2, "V:PREVIOUS_PAGE")], "s string, i int, t string")
    r = N.dispatch(df, "s", ["i"], "t").first()
    assert (r.state, r.handled, r.refused) == ("ASK_PREFERENCES", 1, 1)


def test_debounce_measures_from_the_accepted_event(spark):
    df = spark.createDataFrame([("b", t * 1000, t) for t in (0, 100, 290, 310, 500, 700)], "k string, us long, event_id long")
    assert sorted(r.event_id for r in N.debounce(df, "k", "us", "event_id", 300).collect()) == [0, 310, 700]


def test_sessions(spark):
    log = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2024-01-01', NULL, 'en', 'original', 1, 0), ('a', 2, timestamp'2024-01-02', 'b2', 'ta', 'translated', 2, 5), ('b', 3, timestamp'2024-01-03', 'x', 'hi', 'original', 1, 1) AS t(session_id, seq, ts, book_id, preferred_language, read_mode, current_page, current_sentence)")
    a = H.upsert(log).filter("session_id = 'a'").first()
    assert a.book_id is None and a.start_time.day == 1 and a.last_updated.day == 2 and (a.preferred_language, a.current_page) == ("ta", 2)
    again = H.merged(H.upsert(log.filter("seq < 2")), log.filter("seq >= 2")).orderBy("session_id").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in H.upsert(log).select(*again[0].__fields__).orderBy("session_id").collect()]


def test_duplicates_are_within_a_session(spark):
    df = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("a", 3, "h"), ("a", 4, ""), ("a", 5, ""), ("a", 6, None), ("a", 7, None)], "session_id string, seq int, image_hash string")
    assert [r.seq for r in H.duplicates(df).filter("is_duplicate").collect()] == [3]


def test_ids_have_no_gaps(spark):
    got = sorted(r.id for r in H.with_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq")).repartition(5), 40, "seq").collect())
    assert got == list(range(41, 1041))


def test_translation_runs_once_for_each_sentence(spark, tmp_path):
    log = str(tmp_path / "calls")

    def translator(s, a, b):
        with open(log, "a") as f:
            f.write(s + "\n")
        if s == "bad":
            raise ValueError
        return s.upper()

    rows = [(1, "one", "hin", "en"), (2, "one", "hi", "EN"), (3, "same", "eng", "en"), (4, " ", "hi", "en"), (5, "bad", "hi", "en")]
    df = spark.createDataFrame(rows, "id int, sentence string, src string, tgt string")
    got = {r.id: r.translated for r in H.translate(df, "src", "tgt", translator).collect()}
    assert got == {1: "ONE", 2: "ONE", 3: "same", 4: "", 5: "bad"}
    assert sorted(open(log).read().split()) == ["bad", "one"]


def test_image_status(spark):
    def image(i, f):
        return [(i, y, x, int(f(y, x))) for y in range(24) for x in range(24)]

    rows = image(1, lambda y, x: 10) + image(2, lambda y, x: 255) + image(3, lambda y, x: 120) + image(4, lambda y, x: 255 * ((x // 2 + y // 2) % 2)) + image(5, lambda y, x: 100 + x)
    df = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    got = {r.image_id: r.status for r in I.quality(df).collect()}
    assert got == {1: "IMAGE_TOO_DARK", 2: "IMAGE_TOO_BRIGHT", 3: "IMAGE_TOO_BLURRY", 4: "OK", 5: "IMAGE_TOO_BLURRY"}


def test_laplacian_and_blur_against_numpy(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (7, 9))
    df = spark.createDataFrame([(1, y, x, int(img[y, x])) for y in range(7) for x in range(9)], "image_id long, y int, x int, v int")
    wide = np.pad(img, 1, mode="reflect")
    lap = wide[1:-1, :-2] + wide[1:-1, 2:] + wide[:-2, 1:-1] + wide[2:, 1:-1] - 4 * img
    got = {(r.y, r.x): r.lap for r in I.laplacian(df).collect()}
    assert all(got[y, x] == lap[y, x] for y in range(7) for x in range(9))
    k = np.array([1, 2, 1])
    blur = (sum(a * b * wide[i : i + 7, j : j + 9] for i, a in enumerate(k) for j, b in enumerate(k)) + 8) >> 4
    assert {(r.y, r.x): r.v for r in I.blur3(df).collect()} == {(y, x): int(blur[y, x]) for y in range(7) for x in range(9)}


def test_corners(spark):
    df = spark.createDataFrame([([(90.0, 10.0), (12.0, 12.0), (10.0, 95.0), (88.0, 90.0)],)], "p array<struct<x:double,y:double>>")
    r = df.select(I.order_points(F.col("p")).alias("c")).select("c", I.area(F.col("c")).alias("a"), I.warp_size(F.col("c"))[0].alias("w")).first()
    assert [tuple(p) for p in r.c] == [(12, 12), (90, 10), (88, 90), (10, 95)] and r.w == 78 and 6000 < r.a < 6500


def test_kernels():
    flat = np.full((50, 60), 120, np.uint8)
    for run in (K.unsharp, K.bilateral, lambda x: K.gaussian_blur(x, 5), K.upscale):
        assert np.unique(run(flat)).tolist() == [120]
    assert K.upscale(flat).shape == (75, 90)
    assert (K.adaptive_gaussian(flat) == 255).all()
    ramp = np.tile(np.linspace(90, 240, 900).astype(np.uint8), (100, 1))
    page = np.where((np.indices(ramp.shape).sum(axis=0) % 9) == 0, ramp // 3, ramp).astype(np.uint8)
    even = K.normalize_illumination(page)
    paper = (np.indices(ramp.shape).sum(axis=0) % 9) != 0
    assert even[paper].std() < ramp[paper].std() / 3
    low = (100 + np.indices((64, 64)).sum(axis=0) // 8).astype(np.uint8)
    assert K.clahe(low).std() > low.std()
    same = K.warp(page, np.array([[0, 0], [899, 0], [899, 99], [0, 99]]), 900, 100)
    assert np.abs(same.astype(int) - page).max() <= 1
    assert (K.unsharp(page).astype(int).std()) > page.std()


def test_kernel_over_pixels(spark):
    df = spark.createDataFrame([(i, y, x, (x * y * i) % 256) for i in (1, 2) for y in range(8) for x in range(6)], "image_id long, y int, x int, v int")
    assert K.apply(df, K.upscale).groupBy("image_id").count().filter("count = 108").count() == 2


def test_variants_of_images(spark):
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    rows = [(1, 30, 20, img.tobytes()), (2, 30, 20, None), (3, 0, 0, b""), (4, 30, 21, img.tobytes())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "image_id long, width int, height int, content binary, variant string")
    got = K.make_variants(df).collect()
    assert [r.variant for r in sorted((r for r in got if r.image_id == 1), key=lambda r: r.ord)] == [v[0] for v in K.dims.VARIANTS]
    assert sorted(r.image_id for r in got if r.error == "INVALID_IMAGE") == [2, 3, 4]
    assert {r.variant: bytes(r.content) for r in got if r.image_id == 1}["sharpened"] == K.unsharp(K.normalize_illumination(img)).tobytes()
    assert len([r for r in K.make_variants(df, fast=True).collect() if r.image_id == 1]) == 6
    assert K.make_variants(df.filter("image_id > 9")).collect() == []
    assert len(K.variants(np.zeros((2, 2400), np.uint8))) == 8


def test_page_regions(spark):
    img = (np.indices((100, 120)).sum(axis=0) % 256).astype(np.uint8)
    quads = {1: [(10.0, 10.0), (109.0, 10.0), (109.0, 89.0), (10.0, 89.0)], 2: None, 3: [(0.0, 0.0), (60.0, 60.0), (60.0, 60.0), (0.0, 0.0)], 4: [(0.0, 0.0)], 5: [(1.0, 1.0), (20.0, 1.0), (20.0, 20.0), (1.0, 20.0)]}
    df = spark.createDataFrame([(i, 120, 100, img.tobytes(), q) for i, q in quads.items()] + [(6, 120, 100, None, None)], "image_id long, width int, height int, content binary, corners array<struct<x:double,y:double>>")
    got = {r.image_id: r for r in K.page_regions(df).collect()}
    assert (got[1].width, got[1].height, got[1].was_warped) == (99, 79, True)
    flat = np.frombuffer(got[1].content, np.uint8).reshape(79, 99)
    assert np.abs(flat[[0, 0, -1, -1], [0, -1, 0, -1]].astype(int) - img[[10, 10, 89, 89], [10, 109, 10, 109]]).max() <= 1
    assert all((got[i].width, got[i].height, got[i].was_warped) == (108, 90, False) for i in (2, 3, 4))
    assert bytes(got[2].content) == img[5:95, 6:114].tobytes()
    assert bytes(got[5].content) == img.tobytes() and got[5].was_warped and got[6].width is None


def test_written_graymap_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(7, 3, 2, bytes([0, 10, 200, 255, 13, 7]))], "image_id long, width int, height int, content binary")
    made = df.select(K.graymap(F.col("width"), F.col("height"), F.col("content")).alias("content"), F.lit("a").alias("path"))
    assert sorted((r.y, r.x, r.v) for r in folders.raw_gray(made).collect()) == [(0, 0, 0), (0, 1, 10), (0, 2, 200), (1, 0, 255), (1, 1, 13), (1, 2, 7)]


def test_graymap_scan(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes([0, 10, 200, 255, 13, 7]))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8 nothing")
    found = folders.image_files(spark, str(tmp_path))
    assert found.count() == 2
    assert sorted((r.y, r.x, r.v) for r in folders.raw_gray(found).collect()) == [(0, 0, 0), (0, 1, 10), (0, 2, 200), (1, 0, 255), (1, 1, 13), (1, 2, 7)]


def test_sessions_by_batches(spark, tmp_path):
    from pagelight.streaming import stateful

    rng = random.Random(5)
    rows = [(f"s{rng.randrange(30)}", i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"b{i % 7}", "en", "original", i, i % 9) for i in range(240)]
    schema = "session_id string, seq long, ts string, book_id string, preferred_language string, read_mode string, current_page int, current_sentence int"
    every = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    for n in range(4):
        every.filter(F.floor(F.col("seq") / 60) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for buckets in (1, 8):
        got = stateful.upsert_to_end(stream, f"file://{tmp_path}", buckets)
        want = H.upsert(every)
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_settings(spark):
    spark.conf.set("pagelight.fast_mode", "Yes")
    spark.conf.set("pagelight.languages", "eng+tam")
    s = folders.Settings.load(spark)
    assert s.pin_light == 24 and s.save_images and s.folders["ocr"] == "data/ocr"
    assert s.fast_mode and s.language_list == ["eng", "tam"] and s.early_stop_score == 85.0 and s.resolution == (1920, 1080)
    spark.conf.unset("pagelight.fast_mode")
    spark.conf.unset("pagelight.languages")


@pytest.mark.parametrize("name", ["script_ranges", "language_codes", "language_pairs", "variants", "intent_patterns", "led_by_state", "fsm_edges", "fsm_rules"])
def test_dimension_tables(spark, name):
    assert dims.table(spark, name).count() >= 6


def test_tables_and_append(spark, tmp_path):
    H.create_tables(spark)
    H.create_tables(spark)
    assert spark.table("page_history").columns[0] == "id"
    spark.sql("DROP TABLE page_history")
    spark.sql("DROP TABLE reading_sessions")


def test_folds_of_many_events_on_one_key(spark):
    import time

    n = 200_000
    began = time.time()
    asked = spark.range(n).selectExpr("1 AS s", "id AS i", "CASE id % 3 WHEN 0 THEN 'WAIT_WAKE_WORD' WHEN 1 THEN 'WAIT_START' ELSE 'ERROR' END AS requested")
    got = N.replay(asked, "s", ["i"], "requested").agg({"accepted": "count"}).collect()[0][0]
    kept = N.debounce(spark.range(n).selectExpr("1 AS k", "id * 100000 AS us", "id AS event_id"), "k", "us", "event_id", 300).count()
    assert got == n and kept == -(-n // 3) and time.time() - began < 60


def test_ids_of_a_table_whose_ranges_are_joined(spark):
    """Wide rows and their narrow counts are shuffled in sizes so unlike that ranges are joined differently for each."""
    n = 60_000
    pad = F.concat(*[F.sha2(F.concat("id", F.lit(f" {i}")), 512) for i in range(4)])
    wide = spark.range(n).select((F.col("id") * 7 % n).alias("seq"), pad.alias("pad")).repartition(5)
    wrong = F.count(F.when(F.col("id") != F.col("seq") + 41, 1))
    got = H.with_ids(wide, 40, "seq").agg(F.count("*").alias("n"), F.max("id").alias("top"), wrong.alias("wrong"), F.max(F.length("pad")).alias("width")).first()
    assert (got.n, got.top, got.wrong, got.width) == (n, n + 40, 0, 512)


def test_search_gathers_words_once(spark):
    """Words are read and shuffled once, whatever the search does with their candidates; places that are null are places."""
    words = [(c, b, p, n, o, t, 90, 12) for c in (10, 11, 15) for o, (b, p, n, t) in enumerate([(1, 1, 1, "One "), (1, 1, 1, "two."), (1, 1, 2, " "), (1, 1, 3, "Three"), (1, 2, 3, "four"), (2, 2, 3, "five"), (None, None, None, "zero")])]
    heard = spark.createDataFrame(words, "cand long, block_num int, par_num int, line_num int, ord long, text string, conf int, height int")
    assert {r.text for r in R.reconstruct(heard, "cand").collect()} == {"zero\n\nOne two.\nThree\n\nfour\n\nfive"}
    cands = spark.createDataFrame([(10 + o, 1, o, f"v{o}", 4, "eng", o == 5) for o in (0, 1, 5)], "cand long, page_id long, ord int, variant string, psm int, lang string, is_fallback boolean")
    pages = spark.createDataFrame([(1, "OK", "eng"), (2, "OK", "eng"), (3, "IMAGE_TOO_DARK", "eng")], "page_id long, status string, script string")
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    done = {r.page_id: r for r in R.process(pages, cands, heard.mapInArrow(counted, heard.schema)).collect()}
    assert done[1].selected_variant == "v0" and done[1].is_valid and not done[2].is_valid and not done[3].is_valid
    assert calls.value == len(words)


def test_search_in_one_exchange(spark):
    rng = random.Random(4)
    rows = [(p, o, rng.choice([10.0, 39.99, 40.0, 84.0, 85.0, 90.0]), o >= 900, f"v{o}") for p in range(200) for o in rng.sample([0, 1, 10, 11, 900, 901], rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "page int, ord int, score double, is_fallback boolean, variant string")
    tried = R.evaluated(df.filter("NOT is_fallback"), "page")
    want = R.with_fallback(tried, df.filter("is_fallback"), df.select("page").distinct(), "page")
    assert sorted(map(str, R.searched(df, "page").collect())) == sorted(map(str, want.collect()))


def test_page_text_is_that_of_the_words(spark):
    """Text made inside a row, by lines or by mixed words, is what the word table of the same rows gives."""
    rng = random.Random(7)
    bits = ["a", "bc", "\u00a0", " ", "  ", "\t", "\n", "\r\n", "\f", "\u2003", "\u2028", "\u0085", "\x0b", "\x1c", "\u200b", "é", "नम"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(120)))) for i in range(300)] + [(i, "".join(rng.choices(bits, k=60))) for i in range(280, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.text for r in R.reconstruct(P.words(docs), "doc_id").collect()}
    got = {r.doc_id: r.text for r in docs.groupBy("doc_id").agg(P.page_text(F.collect_list("text")).alias("text")).collect()}
    assert {k: t for k, t in got.items() if t} == want and len(got) == 300
