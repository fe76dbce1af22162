import random
import re

import numpy as np
import pytest

from tabulon.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose_of(r, size=8):
    return lambda n: " ".join("".join(r.choices("abcdefghijklm", k=size)) for _ in range(n))


def passages(spark, texts):
    return substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()


def covered(spark, texts):
    """For each document the words that stand in its passages."""
    out = {i: set() for i in texts}
    for x in passages(spark, texts):
        out[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    return out


def exact_cover(texts):
    """By brute force: the words of each document that stand in a run of LEAST words that an earlier one has."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = [x.lower() for x in WORD.findall(texts[i] or "")]
        runs = [tuple(w[j : j + substring_dedup.LEAST]) for j in range(len(w) - substring_dedup.LEAST + 1)]
        out[i] = {x for j, run in enumerate(runs) if run in seen for x in range(j, j + substring_dedup.LEAST)}
        seen |= set(runs)
    return out


def test_chains_against_brute_force():
    r = random.Random(3)
    cost = substring_dedup.K / (2 * substring_dedup.GAP)
    for _ in range(60):
        found = []
        for _ in range(r.randint(1, 14)):
            t, s, n = r.randint(0, 60), r.randint(0, 60), r.randint(0, 12)
            found.append((t, s, t + n, s + n, 5 + n))
        found = sorted(set(found))
        score = [0.0] * len(found)
        for i, (t, s, _, _, gain) in enumerate(found):
            score[i] = gain + max([0.0, *(score[j] - cost * (t - x[2] + s - x[3]) for j, x in enumerate(found[:i]) if x[2] < t and x[3] < s)])
        best = substring_dedup.chains(found)[0]
        value = sum(x[4] for x in best) - cost * sum(y[0] - x[2] + y[1] - x[3] for x, y in zip(best, best[1:], strict=False))
        assert abs(value - max(score)) < 1e-9


def test_gap_alignment_is_a_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(80):
        x, y = (np.array([r.randint(0, 4) for _ in range(r.randint(0, 9))]) for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            row = [0, *row]
            new = [0]
            for j, b in enumerate(y, 1):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j - 1]))
            row = new
        at, to = substring_dedup.gap_columns(x, y)
        assert at[at >= 0].tolist() == list(range(len(x))) and to[to >= 0].tolist() == list(range(len(y)))
        both = (at >= 0) & (to >= 0)
        agree = int((x[at[both]] == y[to[both]]).sum()) if both.any() else 0
        assert agree == row[-1] or len(x) == len(y)


def test_words_of_any_length(spark):
    texts, want = {}, {}
    for i, (size, n) in enumerate((size, n) for size in (8, 200, 250) for n in (50, 60, 100, 200)):
        passage = prose_of(random.Random(size + n), size)(n)
        for j, (before, text) in enumerate(((0, passage), (0, passage + " end"), (1, "begin " + passage))):
            texts[3 * i + j], want[3 * i + j] = text, set(range(before, before + n)) if j else set()
    assert covered(spark, texts) == want


@pytest.mark.parametrize("between", [60, 120])
def test_two_passages_with_other_words_between(spark, between):
    r = random.Random(between)
    prose = prose_of(r)
    first, second = prose(60), prose(60)
    texts = {i: " ".join([prose(40), first, prose(between), second, prose(40)]) for i in (1, 2)}
    got = passages(spark, texts)
    assert sorted((x["doc_id"], x["start_word"], x["end_word"], x["similarity"]) for x in got) == [(2, 40, 100, 1.0), (2, 100 + between, 160 + between, 1.0)]


def test_passages_whose_parts_stand_in_other_documents(spark):
    prose = prose_of(random.Random(6))
    texts = {}
    for i in range(0, 240, 12):
        passage = prose(60).split()
        for j in range(3):  # sentences of 20 words, each also in an earlier document
            texts[i + j] = " ".join([prose(30), *passage[20 * j : 20 * j + 20], prose(30)])
        texts[i + 3] = " ".join([prose(40), *passage, prose(20)])
        texts[i + 4] = " ".join([prose(25), *passage, prose(20)])
        passage = prose(55).split()
        texts[i + 5] = " ".join([prose(30), *passage[:30], prose(30)])
        texts[i + 6] = " ".join([prose(40), *passage, prose(20)])
        texts[i + 7] = " ".join([prose(25), *passage, prose(20)])
    got = covered(spark, texts)
    assert all(got[i + 4] >= set(range(25, 85)) and got[i + 7] >= set(range(25, 80)) for i in range(0, 240, 12))
    assert all(not got[i + j] for i in range(0, 240, 12) for j in (0, 1, 2, 5))


def test_a_document_with_several_copies_of_a_passage(spark):
    prose = prose_of(random.Random(7))
    passage, other = prose(60), prose(60)
    texts = {
        1: " ".join([prose(30), passage, prose(30)]),
        2: " ".join([passage, prose(40), passage, prose(35), passage]),
        3: " ".join([prose(20), other, prose(20), other]),  # within one document alone
        4: "one " * 60,
        5: prose(10) + " " + "one " * 500 + prose(10),
    }
    got = covered(spark, texts)
    assert got[2] == {*range(60), *range(100, 160), *range(195, 255)} and not got[1] and not got[3] and not got[4]
    assert got[5] == set(range(10, 510))
    left = substring_dedup.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("doc_id = 2").first()
    assert passage not in left["text"] and len(left["text"].split()) == 75


def test_every_exact_run_is_covered(spark):
    """Against a brute-force finder, on texts put together from few pieces, so that runs have many holders in part."""
    r = random.Random(12)
    prose = prose_of(r, 6)
    pieces = [prose(r.choice([3, 9, 20, 35, 52, 70])) for _ in range(30)]
    texts = {i: r.choice([" ", "\n"]).join([*r.choices(pieces, k=r.randint(1, 9)), prose(r.randint(0, 20))]) for i in range(150)}
    want, got = exact_cover(texts), covered(spark, texts)
    assert sum(map(len, want.values())) > 3000
    assert [i for i in texts if not got[i] >= want[i]] == []


def test_real_texts_are_covered(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = exact_cover(texts)
    got = {i: set() for i in texts}
    for x in substring_dedup.repeated_passages(docs).collect():
        got[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    assert [i for i in texts if not got[i] >= want[i]] == [] and any(want.values())


def test_recall_of_passages_that_are_nearly_the_same(spark):
    """Words at random places replaced, in half of the trials a word taken out or put in besides: found is 80 % of the words."""
    r = random.Random(60)
    vocabulary = prose_of(r, 6)(20_000).split()
    prose = lambda n: r.choices(vocabulary, k=n)
    texts, trials, kinds = {}, 100, [(0.1, 60, 0.97), (0.25, 60, 0.9), (0.25, 120, 0.95)]
    for n, (edits, words, _) in enumerate(kinds):
        for i in range(10_000 * n, 10_000 * n + trials):
            passage = prose(words)
            changed = list(passage)
            for j in r.sample(range(words), round(edits * words) - (i % 2)):
                changed[j] = r.choice(vocabulary)
            if i % 2:
                j = r.randrange(5, words - 5)
                changed[j : j + 1] = r.choice([[], [*prose(1), changed[j]]])
            texts[i] = " ".join([*prose(40), *passage, *prose(40)])
            texts[1000 + i] = " ".join([*prose(35), *changed, *prose(30)])
    got = covered(spark, texts)
    for n, (_, words, least) in enumerate(kinds):
        ids = range(10_000 * n, 10_000 * n + trials)
        assert sum(len(got[1000 + i] & set(range(35, 35 + words))) >= 0.8 * words for i in ids) / trials >= least
        assert all(len(got[1000 + i] - set(range(35, 36 + words))) <= 12 for i in ids) and not any(got[i] for i in ids)


def test_odd_rows(spark, odd, empty):
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(odd).collect()} == {2, 3}
    left = substring_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    before, after = ({(r["doc_id"], r["text"]): r for r in df.collect()} for df in (odd, left))
    assert {k for k in after if k not in before} == {(2, ""), (3, " extra words here")}
    assert all(r[c] == "mine" for r in after.values() for c in odd.columns[5:])
    assert {r["n_chars"] for r in after.values() if r["doc_id"] == 6} == {5}  # not counted anew where nothing changed
    assert substring_dedup.repeated_passages(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


def test_repeated_doc_ids(spark):
    prose = prose_of(random.Random(9))
    first, second = prose(70), prose(70)
    rows = [(1, first), (1, second), (2, first), (2, first), (3, second)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["doc_id"] in (2, 3) and got[0]["source_doc_id"] == 1


def test_rarest_seed_of_each_run():
    r = random.Random(8)
    for _ in range(50):
        places = np.array(sorted(r.sample(range(300), 90)))
        seeds, counts = np.array([r.randrange(40) for _ in places]), np.array([r.randrange(1, 6) for _ in places])
        low, high = 20, 180
        wanted = []
        for begin in range(low, high + 1):
            inside = [i for i, x in enumerate(places) if begin <= x <= begin + substring_dedup.LEAST - substring_dedup.K]
            if inside:
                i = min(inside, key=lambda i: (counts[i], seeds[i], -places[i]))
                wanted.append((int(seeds[i]), int(places[i]) - begin))
        assert list(substring_dedup.rarest(places, seeds, counts, low, high)) == wanted


def test_seeds_are_made_and_shuffled_once(spark, monkeypatch):
    plans, real = [], substring_dedup.cut

    def cut(df):
        if {"seed", "head"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(substring_dedup, "cut", cut)
    prose = prose_of(random.Random(8))
    text = prose(80)
    assert covered(spark, {1: text, 2: prose(30) + " " + text}) == {1: set(), 2: set(range(30, 110))}
    assert [p.count("Exchange hashpartitioning(") for p in plans] == [1]


@pytest.mark.parametrize("held", [4, 30, 1 << 19])
def test_shared_seeds_against_brute_force(monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    r = random.Random(held)
    for _ in range(60):
        rows = []
        for seed in [r.choice([r.randrange(-(2**63), 2**63), r.randrange(-9, 9)]) for _ in range(r.randrange(8))]:
            for doc in {r.randrange(-5, r.choice([-4, 3, 60])) for _ in range(r.choice([1, 4, 90]))}:
                rows += [(seed, doc, r.randrange(99) if i == 0 else -1 - r.randrange(99)) for i in range(r.randrange(1, 4))]
        r.shuffle(rows)
        of = {}
        for seed, doc, at in rows:
            of.setdefault(seed, []).append((doc, at))
        want = []
        for seed, places in of.items():
            head = min(d for d, _ in places)
            first = min(at for d, at in places if d == head and at >= 0)
            want += [(seed, d, at, head, first) for d, at in places if max(places)[0] > head]
        parts = [np.array(rows[i : i + 7], substring_dedup.HIT) for i in range(0, len(rows), 7)]
        got = [row for b in substring_dedup._headed_rows(iter(parts)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("held", [4, 30, 1 << 19])
def test_seeds_by_text_against_brute_force(monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    r = random.Random(held)
    for _ in range(40):
        rows = []
        for seed in [r.choice([r.randrange(-(2**63), 2**63), r.randrange(-9, 9)]) for _ in range(r.randrange(8))]:
            for doc in {r.randrange(-5, r.choice([-4, 3, 60])) for _ in range(r.choice([1, 4, 20]))}:
                first = r.randrange(50)
                rows += [(seed, doc, first), *((seed, doc, -1 - at) for at in r.sample(range(first + 1, 99), r.choice([0, 0, 2, 40])))]
        rows = list(dict.fromkeys(rows))
        r.shuffle(rows)
        of = {}
        for seed, doc, at in rows:
            of.setdefault(seed, {}).setdefault(doc, []).append(at)
        want = {(seed, doc): (sorted(at), min(docs), sum(map(len, docs.values()))) for seed, docs in of.items() if len(docs) > 1 for doc, at in docs.items()}
        parts = [np.array(rows[i : i + 7], substring_dedup.HIT) for i in range(0, len(rows), 7)]
        got = {}
        made = [x for b in substring_dedup._headed_rows(iter(parts), give=substring_dedup._by_text) for x in b.to_pylist()]
        for x in made:
            assert x["again"] != [] and x["source_at"] == min(at for at in of[x["seed"]][x["head"]] if at >= 0)
            got.setdefault((x["seed"], x["doc_id"]), []).append(x)
        assert {k: (sorted(at for x in v for at in [x["at"], *(x["again"] or [])]), v[0]["head"], v[0]["n"]) for k, v in got.items()} == want
        assert len(made) == len(want) or len(rows) > held


def test_a_phrase_that_texts_repeat_has_a_row_for_each_text(spark, monkeypatch):
    """The search for exact runs joins by seed: 200 places of a seed in a text are one row there, not 200."""
    seen, real = [], substring_dedup.cut

    def cut(df):
        out = real(df)
        if {"seed", "doc_id"} <= set(df.columns) and "asks" not in df.columns:
            seen.append((out.count(), out.select("seed", "doc_id").distinct().count()))
        if "marks" in df.columns:
            seen.append((sum(len(r["marks"]) for r in out.collect()), seen[-1][1]))
        return out

    prose = prose_of(random.Random(11))
    phrase, passage = prose(2), prose(60)
    texts = {i: " ".join([prose(5 + i), *[phrase] * 200, prose(9), passage, prose(5)]) for i in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    hits = substring_dedup._headed(docs)
    monkeypatch.setattr(substring_dedup, "cut", cut)
    got = {i: set() for i in texts}
    for x in substring_dedup._exact_runs(docs, hits, spark.createDataFrame([], substring_dedup.PASSAGE)).collect():
        got[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    assert got == exact_cover(texts)
    assert hits.count() == hits.select("seed", "doc_id").distinct().count()
    assert len(seen) == 3 and all(rows <= pairs for rows, pairs in seen)


def test_words_left_out_against_a_plain_search():
    r = np.random.default_rng(4)

    def value(x, y):
        score = best = 0
        for a, b in zip(x, y, strict=False):
            score += 1 if a == b else substring_dedup.APART
            best = max(best, score)
            if best - score > substring_dedup.DROP:
                break
        return best

    for _ in range(400):
        x, y = (r.integers(0, 3, r.integers(0, 60)) for _ in range(2))
        if r.random() < 0.5:
            y = np.delete(x, r.integers(0, max(len(x), 1), 2 * (len(x) > 0)))
        tries = [(value(x[i:], y[j:]) + substring_dedup.APART * (i + j), i, j) for i, j in substring_dedup.LEFT_OUT]
        assert substring_dedup._beyond(x, y) == max(tries, key=lambda t: t[0])
