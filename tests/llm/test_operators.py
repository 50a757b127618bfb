from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusgraph.llm import decontaminate, html_extract, line_dedup, near_dedup, packing, quality_rules, substring_dedup
from corpusgraph.llm import token_counts, tokens, toxicity, url_filter
from corpusgraph.llm.queries import QUERIES

from ..conftest import SMALL
from . import brute

# Names that the operators use inside; they must not get in the way.
CLASHING = "id bigint, row bigint, tokens string, kept boolean, drops string, __id string, component string, n_words int"


def _rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, ties, near copies, shared passages and lines."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ñu", "Aß", "x_y", "1.5"]
    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, line = words(30), "  A line that is found Often, more than once "
    base = words(90)
    rows = [(None, None), (None, "one null id here\n" + line), (1, None), (2, ""), (3, "   \t\n  "), (4, "single"), (5, "Single"),
            (6, "a b"), (7, "same same same same same same same same same same same same"), (8, line + "\n" + line), (9, line.upper())]
    for k in range(12):
        rows.append((10 + k, " ".join([*words(8), *passage, *words(k)]) + "\n" + line + "\nshort\n" + "x" * k))
    for k in range(12):
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(90)] = f"edit{k}"
        rows.append((30 + k, " ".join(near)))
    rows += [rows[-1], (31, "another text of the same id"), (60, "\n".join(" ".join(words(12)) for _ in range(400))), (61, " ".join(passage * 40))]
    return rows


def _frame(spark, rows, extra: bool = True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return spark.createDataFrame([(*r, 7, 7, "t", True, "d", "i", "c", 1) for r in rows], f"doc_id bigint, text string, {CLASHING}").repartition(3)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_substrings_are_removed_as_by_brute_force(spark, monkeypatch):
    rows = _rows()
    for window, part in ((12, 4), (3, 3), (35, 6)):
        got = substring_dedup.dedup_substrings(_frame(spark, rows), window, part)
        assert _sorted(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == _sorted(brute.substrings(rows, window))


def test_substrings_with_many_slices_and_frequent_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "FREQUENT", 1e-9)
    rows = _rows()
    got = substring_dedup.dedup_substrings(_frame(spark, rows), 10, 4)
    assert _sorted(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == _sorted(brute.substrings(rows, 10))


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "rolling", lambda h, size: np.zeros(max(0, len(h) - size + 1), np.uint64))
    raw = np.frombuffer(b"a b c d\nb c d e\nx y z q", np.uint8)
    row, place, repeated = substring_dedup.repeated_windows(raw, np.array([0, 8, 16, len(raw)]), np.zeros(3, np.uint8), 3)
    assert [(int(r), int(p)) for r, p, x in zip(row, place, repeated) if x] == [(0, 1), (1, 0)]


def test_rolling_and_sliding():
    h = np.array([5, 7, 5, 7, 5, 9], np.uint64)
    rolled = substring_dedup.rolling(h, 2)
    assert rolled[0] == rolled[2] and rolled[1] == rolled[3] and len(set(rolled.tolist())) == 3
    values = np.array([4, 2, 8, 1, 9, 3, 7], np.uint64)
    for size in range(1, 8):
        assert substring_dedup.sliding_min(values, size).tolist() == [min(values[i: i + size]) for i in range(8 - size)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_are_dropped_as_by_brute_force(spark, batches, fanout):
    rows = _rows()
    got = line_dedup.dedup_lines(_frame(spark, rows), batches=batches, fanout=fanout)
    assert _sorted(got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == _sorted(brute.lines(rows))


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_as_by_brute_force(spark, shingle, monkeypatch):
    rows = _rows()
    want = _sorted(brute.components(rows, shingle))
    got = near_dedup.near_duplicates(_frame(spark, rows), shingle)
    assert _sorted(got.select("doc_id", "n_shingles", "component_id").collect()) == want
    # Long lists, stars and stragglers.
    monkeypatch.setattr(near_dedup, "LIGHT", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    got = near_dedup.near_duplicates(_frame(spark, rows), shingle)
    assert _sorted(got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_small_sets_link(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d e f g"), (4, "q a b c d e"), (5, "z"), (6, "z"), (7, "A B C D E")]
    got = near_dedup.near_duplicates(_frame(spark, rows), 2)
    assert _sorted(got.select("doc_id", "n_shingles", "component_id").collect()) == _sorted(brute.components(rows, 2))


def test_statistics_and_kept(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(["tree", "house", "water", "go", "seen"]) + str(rng.randrange(300)) for _ in range(120))) for i in range(150)]
    odd = [(1000 + i, " ".join(w + "###$$$" for w in t.split())) for i, (_, t) in enumerate(clean[:5])]
    rows = [(d, t, "en", "s") for d, t in clean + odd] + [(d, t, None, None) for d, t in _rows()]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id bigint, text string, lang string, source string, n_words int, kept boolean")
    got = quality_rules.judge_quality(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert _sorted((r["doc_id"], *(r[n] for n in names)) for r in got) == _sorted((d, *brute.statistics(t)) for d, t, _, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[d] for d, _ in clean) and not any(kept[d] for d, _ in odd)


def test_chi2_quantile():
    assert abs(quality_rules.chi2_quantile(0.95, 4) - 9.488) < 0.05


def _benchmark(spark):
    items = [(1, "Tom has 5 apples and gives 5 of them to Anna, so how many apples are left for Tom now"),
             (2, "the quick brown fox jumps over the lazy dog while the band plays on and on"),
             (3, "the quick brown fox jumps over the lazy dog while the band plays on and on"), (4, None), (5, ""), (6, "what is love")]
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_contaminated_documents(spark):
    same = "the quick brown fox jumps over the lazy dog while the band plays on and on"
    texts = [(None, None), (1, None), (2, ""), (3, "clean words that have nothing to do with any of this at all, really not"),
             (4, "before it " + same.replace("fox", "fox,").replace(" while", "\nwhile") + " and after"),
             (5, "Here: Bob has 9 apples and gives 9 of them to Carla, so how many apples are left for Bob now?"),
             (6, "Here: Bob has 9 apples and gives 8 of them to Carla, so how many apples are left for Dan now?"),
             (7, "the quick brown fox jumps over a fence"), (8, "and what is love then"), (4, "another row of four")]
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontaminate.contaminated(_frame(spark, texts), _benchmark(spark)).collect()}
    assert got == {(4, 2): False, (5, 1): True, (8, 6): False}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert decontaminate.contaminated(empty, _benchmark(spark)).collect() == []
    assert decontaminate.contaminated(_frame(spark, texts), _benchmark(spark).filter("false")).collect() == []


def _found(spark, item: str, text: str):
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    return [tuple(r)[2:] for r in decontaminate.contaminated(_frame(spark, [(1, text)]), benchmark).collect()]


@pytest.mark.parametrize("change", [str.lower, str.upper, str.title, lambda t: t.replace(",", ""), lambda t: t.replace(" Ann", ", Ann")])
def test_letter_case_and_punctuation_hide_no_item(spark, change):
    item = "The train of Tom Miller leaves Berlin, and 5 Miles later it meets Anna Smith, who sold Old Maps in Rome for years"
    [(_, n_item, reworded)] = _found(spark, item, f"before it {change(item)} and after")
    assert (n_item, reworded) == (23, False)


def test_words_put_in_or_left_out_hide_no_item(spark):
    words = [f"word{chr(97 + i)}" for i in range(24)]
    whole, spread = " ".join(words), [*words[:8], "put", *words[8:16], "in", "two", *words[16:]]
    assert _found(spark, whole, " ".join(spread)) == [(24, 24, False)]
    assert _found(spark, whole, " ".join(words[:12] + words[13:])) == [(23, 24, False)]
    assert _found(spark, whole, " ".join([*words[:8], *["apart"] * 30, *words[8:16]])) == []


def test_an_edited_value_hides_no_copy(spark):
    words = " ".join(f"word{chr(97 + i)}" for i in range(26))
    item = f"a cart holds 5 crates {words} and 5 trucks"
    assert _found(spark, item, item.replace("5 trucks", "6 trucks")) == [(34, 34, False)]
    close = item.replace(words, "and more with 5 in it")
    assert _found(spark, close, close.replace("5 trucks", "6 trucks").replace("5 in", "7 in")) == []


@pytest.mark.parametrize("item", [
    "Which of Alice Brown, Bob Smith, Carla Jones, David King, Emma White, and Frank Hall won",
    "Add 12 and 7 and 3.5 km 4 kg 9 81 15 and 6 8 10 20 hours"])
def test_items_full_of_placeholders_are_found_verbatim_alone(spark, item):
    [(n_covered, n_item, reworded)] = _found(spark, item, f"before it {item} and after")
    assert n_covered == n_item and not reworded
    assert _found(spark, item, item.translate(str.maketrans("123456789BSJKWH", "234567891SJKWHB"))) == []


def test_shuffled_benchmark_join_gives_the_same(spark, monkeypatch):
    docs = _frame(spark, [(4, "the quick brown fox jumps over the lazy dog while the band plays on and on")])
    want = decontaminate.contaminated(docs, _benchmark(spark)).collect()
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert decontaminate.contaminated(docs, _benchmark(spark)).collect() == want


def test_encoder_gives_the_ids_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.default_path())
    encode = tokens.Encoder(tokens.default_path())
    for text in ["", " ", "Hello wörld  ñ\n\n x", "a" * 5000, " " * 5000, "x <|endoftext|> y", "１２３ 数字 🙂", *(t or "" for _, t in _rows())]:
        assert encode.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [7, 64, 1 << 19])
def test_token_counts(spark, block):
    rows = _rows() + [(-5, "minus"), (2**62, "large")]
    from corpusgraph.llm.common import Scratch

    folder = Scratch(spark, "test-tokens").path()
    token_counts.write_token_files(_frame(spark, rows), folder)
    got = token_counts.count_tokens(spark, folder, block_tokens=block).select("doc_id", "n_tokens")
    encode = tokens.Encoder(tokens.default_path(), ordinary=True)
    assert _sorted(got.collect()) == _sorted((d, len(encode.ids(t or ""))) for d, t in rows)


def test_token_files_without_ids_and_without_last_separator(spark, tmp_path):
    flat = [5, 6, 50256, 50256, 7, 8, 9, 50256, 1]
    (tmp_path / "a.bin").write_bytes(np.array(flat, ">u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (1, 2, 3, 100):
        got = token_counts.count_tokens(spark, str(tmp_path), header=0, block_tokens=block).orderBy("start")
        assert [r["n_tokens"] for r in got.collect()] == [2, 0, 3, 1]


def test_packing_is_an_exact_cover(spark):
    rows = [r for r in _rows() if r != (31, "another text of the same id")][:-1]
    rows = list(dict(rows).items())
    encode = tokens.Encoder(tokens.default_path())
    for size in (64, 2048):
        got = packing.pack(_frame(spark, rows), size=size).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
        for d, t in rows:
            ids, at = np.append(encode.ids(t or ""), 1).astype("<u4"), 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"]: at].tobytes())
            assert at == len(ids)
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= size
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        tokens_in = sum(r["length"] for r in got)
        assert len(by_sequence) * size - tokens_in <= size + packing.GRID * len(by_sequence)


def test_fit_uses_no_more_than_there_is():
    histogram = {1: 5, 3: 4, 5: 9, 7: 5, 4: 3, 2: 1}
    slots, sequences = packing.places(histogram, 8)
    used = defaultdict(int)
    for length, low, high, _, _ in slots:
        assert low == used[length]
        used[length] = high
    assert sequences > 0 and all(used[n] <= histogram[n] for n in used)
    filled = defaultdict(int)
    for length, low, high, first, _ in slots:
        for k in range(high - low):
            filled[first + k] += length
    assert set(filled.values()) == {8}


def test_decontamination_by_shuffled_windows_of_a_long_text(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(5)]
    long = [rng.choice(words) for _ in range(20_000)]
    long[7_000:7_020], long[19_980:] = items[0][1].split(), items[3][1].split()
    docs = _frame(spark, [(1, " ".join(long)), (2, items[1][1]), (3, None), (4, "w1 w2")])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = _sorted(decontaminate.contaminated(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    found = decontaminate.contaminated(docs, benchmark)
    assert _sorted(found.collect()) == want and {(r[0], r[1]) for r in want} == {(1, 0), (1, 3), (2, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    carried = plan[join + 1][plan[join + 1].index("["):]
    assert "in_window" in carried and " tokens#" not in carried


def test_toxicity_folds_marks_and_look_alikes():
    words = lambda text: [side.split() for side in toxicity.fold_both(text)]
    assert words("бigot") == [["bigot"], []]
    assert words("νile") == [["vile"], []]
    assert words("sc\u200bum sc\u00adum sćúm s\u0336c\u0336um ＳＣＵＭ") == [["scum"] * 5, []]
    assert words("ѕсυм") == [["ѕсυм"], ["scum"]]
    assert words("") == [[], []]
    found = toxicity._automaton({"scum": 2.0}, [])
    for text, want in (("ѕсυм", 2.0), ("scum", 2.0), ("мускул", 0.0), ("идиот", 0.0)):
        assert sum(toxicity.weight_sum(t, found) for t in toxicity.fold_both(text)) == want


def test_toxicity_sums_equal_a_search_of_every_entry(spark):
    lexicon = {"idio": 1.0, "idiot": 2.0, "scum": 1.5, "scumbag": 3.0}
    texts = ["idiots and scumbags", "ѕсυм idiotic clown", "clown fish idiot fish", "", None, "idiom scu scummy " * 300, "xidiot 5cum sc\u200bum"]

    def brute(text):
        total = 0.0
        for side in toxicity.fold_both(text or ""):
            words = side.split()
            for n, word in enumerate(words):
                if word == "idiot" and words[n + 1:n + 2] == ["fish"]:
                    continue
                hits = [e for e in lexicon if word.startswith(e)]
                total += lexicon[max(hits, key=len)] if hits else 0.0
        return total

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = rows.mapInArrow(toxicity._sums(lexicon, ["idiot fish"]), "n int, total double, words double").collect()
    assert {r["n"]: r["total"] for r in got} == {n: brute(t) for n, t in enumerate(texts)}


def test_token_files_reject_what_does_not_fit(spark):
    from corpusgraph.llm.common import Scratch

    docs = _frame(spark, [(1, "a")])
    for options in ({"separator": 80}, {"separator": 70_000}, {"width": 3}):
        with pytest.raises(ValueError):
            token_counts.write_token_files(docs, Scratch(spark, "test-tokens").path(), **options)


def test_toxicity_fold_and_exceptions():
    assert toxicity.fold("You 1D10T, ｓtuрid$$$ идиот").split() == ["you", "idiot", "stupid", "идиот"]
    found = toxicity._automaton({"idiot": 2.0, "clown": 1.0}, ["clown fish"])
    assert toxicity.weight_sum(toxicity.fold("clown fish, clowns and an IDIOT"), found) == 3.0
    lexicon = toxicity.lexicon_of([("idio", 20, 0), ("idiot", 20, 0), ("idioti", 3, 0)], 50, 500)
    assert list(lexicon) == ["idiot"]


def test_toxicity_on_labels(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["tree", "house", "water", "morning", "seen"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["moronic", "M0r0n", "blockhead"])
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] * (1 + i % 2)
    rows += [(None, None), (1000, None), (1001, "")]
    known = spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id bigint, toxic int")
    got = toxicity.fit_toxicity(_frame(spark, rows), known).score(_frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95
    none = toxicity.fit_toxicity(_frame(spark, rows), known.filter("false")).score(_frame(spark, rows)).collect()
    assert len({r["score"] for r in none}) == 1


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://A.Example.ORG:80/es/1?x#y", "https://x.com/fr/", "https://x.com", "https://x.com/de/7",
            "https://notexample.org/es/1", "https://www.example.org/en/17", "ftp://h.net//a//b/", "http://u.net/x://y"]
    pages = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(urls)], "page_id bigint, url string, host string, purity int")
    labels = spark.createDataFrame([(7, 0), (7, 1), (None, 1), (1, None)], "doc_id bigint, quality int")
    got = {r["page_id"]: tuple(r[n] for n in ("host", "path", "rule", "verdict")) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[0][:3] == ("", "", None) and got[1][:3] == ("", "", None)
    assert got[2] == ("a.example.org:80", "/es/1", None, got[2][3])
    assert got[3] == ("x.com", "/fr/", "com/fr/", "allow") and got[4][:3] == ("x.com", "", None)
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("org/", "allow")
    assert got[7][2:] == ("example.org/en/1", "block") and got[8][:2] == ("h.net", "//a//b/") and got[9][:2] == ("u.net", "/x://y")


def test_impure_templates_are_blocked(spark):
    pages = [(i, f"http://h.net/{'junk' if i % 2 else 'good'}/p{i}.html") for i in range(400)]
    labels = [(i, 0 if i % 2 else 1) for i in range(0, 400)]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    for r in got.collect():
        assert r["verdict"] == ("block" if "junk" in r["path"] else "allow")
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge_urls(empty, spark.createDataFrame([], "doc_id bigint, quality int")).collect() == []


def test_templates_and_purities_equal_brute_force(spark):
    from corpusgraph.llm.common import Scratch

    rng = random.Random(5)
    rows = []
    for _ in range(900):
        host = rng.choice(["a.net", "b.net", ""])
        kind = rng.choice(["x", "y", "z"])
        deep = [rng.choice(["u", "v"]) for _ in range(rng.randrange(9))]
        path = [] if rng.random() < 0.1 else [kind, *deep, f"slug{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdef')}"]
        bad = 0.9 if kind == "x" and "v" in deep[:1] else 0.2
        rows.append((host, path, rng.choice([None, int(rng.random() > bad)])))
    frame = spark.createDataFrame([(h, p, y) for h, p, y in rows], "host string, segments array<string>, good int")
    counts = url_filter.label_counts(frame.selectExpr("host", "segments", "1L as n", "good"))
    scratch = Scratch(spark, "test-urls")
    got = url_filter.purities(url_filter.template_tree(counts, scratch), scratch).collect()
    want = brute.url_purities(rows, url_filter.MAX_CHILDREN, url_filter.OWN_SHARE, url_filter.SIMILAR_Z, url_filter.PRIOR)
    assert len(got) == len(want)
    for r in got:
        template, purity = want[r["host"], tuple(r["segments"])]
        assert r["template"] == template and abs(r["purity"] - purity) < 1e-9


def test_templates_that_part_late_and_urls_of_great_length(spark):
    start = "http://h.net/" + "d/" * 9
    pages = [(i, f"{start}{'junk' if i % 2 else 'good'}/p{i}.html") for i in range(400)]
    pages += [(i, f"{start}junk/no-number-{i}x") for i in range(401, 403)] + [(500, "http://h.net/" + "q/" * 3000), (None, None), (1, "http://h.net/")]
    labels = [(i, i % 2 == 0) for i in range(400)]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"),
                                spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id bigint, quality int")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["verdict"] == ("block" if "junk" in r["path"] else "allow")


def test_threshold_on_labels_left_out():
    assert url_filter.clear_threshold([]) == url_filter.MIN_PURITY
    assert url_filter.clear_threshold([(700, 80, 20), (800, 82, 18), (900, 79, 21)]) == url_filter.MIN_PURITY
    assert url_filter.clear_threshold([(550, 10, 30), (600, 20, 30), (900, 300, 20)]) == 0.601
    assert url_filter.clear_threshold([(100, 1, 90), (900, 300, 20)]) == url_filter.MIN_PURITY


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">home of menus and more</a></li></ul></nav><div class="ad">Buy now and always</div>
<article><h1>The  Head</h1><p>First <b>bo</b>ld &amp; caf&eacute;<br>line<p>Second <a href="x>y">link</a> one.
<aside>Sidebar words here</aside><ul><li>item one</li><li>item two</li></ul><script>var a = "<p>no</p>";</script><!-- <p>hidden</p> -->
<div id="cookie-notice">We use cookies</div><p>Last &#8211; part</p></article>
<section id="comments"><p>I like this very very much indeed, great text</p></section><form>Sign <input> up</form><footer>&copy; all rights of the site</footer></body>"""


@pytest.mark.parametrize("page, want", [
    ("<p>one two</p><button>go<p>three four five</p>", "one two\nthree four five"),
    ("<p>one two</p><iframe src=x>go<p>three four five</p>", "one two\nthree four five"),
    ("<p>one <span><button>go</span> two</p>", "one two"),
    ("<div><select><option>q<option>r</div><p>three four</p>", "three four"),
    ("<title>t<body><p>one two</p>", "one two"),
    ("<script>a<p>b c d</p>", "b c d"),
    ("<script>if (a<b) '<p>'</script><style>p</style><p>w w</p>", "w w"),
    ("<p>x <button>y</button> z</p>", "x z"),
    ("<noscript><p>turn it on</p></noscript><p>one two</p>", "one two"),
    ("</button>a b<textarea>c", "a b"),
    ("<title>a <select> <textarea> <b>" * 20_000 + "<p>one two</p>", "one two"),
    ("<p>one two</p>" * 20_000, "\n".join(["one two"] * 20_000)),
])
def test_main_text_of_unclosed_and_long_pages(page, want):
    assert html_extract.main_text(page, {}) == want


def test_best_region_equals_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(12))]
        low, high = html_extract.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[low:high]) == max([0.0, *sums])


def test_main_text():
    want = "The Head\nFirst bold & café line\nSecond link one.\nitem one\nitem two\nLast – part"
    assert html_extract.main_text(PAGE, {}) == want
    for text in ("", "   ", "<p", "<p>", "</p></p>", "<nav>only menu</nav>", "<!-- open", "<script>x"):
        assert html_extract.main_text(text, {}) == ""
    assert html_extract.main_text("plain words", {}) == "plain words"
    assert html_extract.best_region([-1.0, 2.0, -0.5, 2.0, -9.0, 3.0]) == (1, 4)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (None, "u", PAGE, "t"), (2, "u", "<p>a b", "t")], "page_id bigint, url string, html string, text string")
    got = _sorted(html_extract.extract_text(pages).select("page_id", "n_chars").collect())
    assert got == _sorted([(1, 0), (2, 0), (2, 3), (None, len(html_extract.main_text(PAGE, {})))])
    assert html_extract.learn_weights(pages, spark.createDataFrame([], "doc_id bigint, text string")) == {}


def test_operators_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for run in (substring_dedup.dedup_substrings, line_dedup.dedup_lines, near_dedup.near_duplicates, quality_rules.judge_quality,
                packing.pack, token_counts.document_token_counts):
        assert run(empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
