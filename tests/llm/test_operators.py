"""The training-text operators against plain versions, on small tables and on odd ones."""

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from phonoscope.llm import chat_format, common, decontaminate, exact_dedup, graph, language_id, mixing, near_copies, passage_dedup, simhash, suffix_dedup, token_counts, toxicity
from phonoscope.llm.queries import ORACLES, QUERIES
from tests.compare import ROOT, same

SIZE = f"{ROOT}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, kept boolean"
SYLLABLES = ("on ", "the ", "an", "re", "ing ", "of ", "th", "er ", "in ", "at ", ". ", "x", "é")


def junk(rng, n):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def table(spark, texts, ids=None):
    """A table documents with columns whose names clash with what operators make."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, None, "r", 7, None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, ties, repeated rows, null and repeated ids."""
    rng = random.Random(1)
    base = junk(rng, 200)
    texts = [None, "", " \t\n", base, base, base + " end", "a" * 50000, junk(rng, 30000), "Ünïcode 東京 😀", base, None, "x"]
    return table(spark, texts, [5, 6, 7, 8, 9, 10, 11, 12, None, None, 8, 8])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(QUERIES[name], ORACLES[name], spark, SIZE)


def documents(spark, folder=SIZE):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


# ---- exact dedup ----


def test_exact_groups_on_odd_rows(spark, odd):
    rows = odd.collect()
    found = exact_dedup.exact_groups(odd).collect()
    assert len(found) == len(rows)
    size = Counter(r.text or "" for r in rows)
    kept = Counter()
    for r in found:
        text = r.row.text or ""
        ids = [x.doc_id for x in rows if (x.text or "") == text and x.doc_id is not None]
        assert r.group_size == size[text] and r.keep_id == (max(ids) if ids else None)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        kept[text] += r.kept
    assert set(kept.values()) == {1} and exact_dedup.drop_copies(odd).columns == odd.columns
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_exact_groups_differ_late(spark):
    texts = ["q" * n + end for n in (60, 64, 600, 5000, 40000) for end in ("a", "b", "b", "")]
    found = {r.row.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        same_text = [i for i, x in enumerate(texts) if x == t]
        assert found[k] == (max(same_text), len(same_text))


# ---- simhash ----


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(spark):
    found = {r.doc_id: r for r in simhash.op4_simhash(spark, SIZE).collect()}
    prints = {i: plain_fingerprint(t) for i, t in documents(spark).items()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in found.items()} == reach(prints, near)


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_connect_what_pairs_connect(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(60)}
    values = {simhash._signed(v) for v in values} | {0}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for distance in (0, 1, 2):
        near = [(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
        pairs = [tuple(r) for r in simhash.links(fps, distance).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in pairs)
        assert reach(values, pairs) == reach(values, near)


def test_allocation():
    assert simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 3}], 0) == (3, [-1, 1])
    groups = simhash.partition_bits(10, np.eye(64) * 5, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} <= {21, 22}


def test_near_groups_on_odd_rows(spark, odd):
    found = simhash.near_groups(odd).collect()
    assert len(found) == odd.count() and len({r.component_id for r in found if r.fp == 0}) == 1
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert found == reach({n for p in pairs if p[0] != p[1] for n in p}, [p for p in pairs if p[0] != p[1]])


def words_of(rng, n):
    return ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize(("crowd", "block", "many"), [(2, 4, 1), (48, 512, 4)])
def test_near_copies(spark, crowd, block, many, monkeypatch):
    for name, value in (("CROWD", crowd), ("BLOCK", block), ("MANY", many)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        words = words_of(rng, 150)
        texts.append(" ".join(words))
        for _ in range(7):
            copy = list(words)
            copy[rng.randrange(150)] = "changed"
            texts.append(" ".join(copy))
    texts += [" ".join(words_of(rng, 120)) for _ in range(20)] + [None, "", "two words", "Two Words"]
    docs = table(spark, texts)
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == {0, 8, 16, 24, 32, 40, *range(48, 71)}
    assert near_copies.drop_near_copies(docs).columns == docs.columns
    links = near_copies.near_links(common.with_rid(docs, "doc_id", "text")).collect()
    sets = [set(near_copies.shingle_set(t or "").tolist()) for t in texts]
    assert all(len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]) for u, v in links)


@pytest.mark.parametrize(("crowd", "block", "many"), [(2, 512, 4), (2, 4, 1), (48, 512, 4)])
def test_near_copies_with_block_edits(spark, crowd, block, many, monkeypatch):
    for name, value in (("CROWD", crowd), ("BLOCK", block), ("MANY", many)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(33)
    texts = []
    for n in [60, 120, 300, 600] * 8:
        words = words_of(rng, n)
        cut, at = int(n * 0.17), rng.randrange(n // 2)
        edited = [*words[:at], *words_of(rng, n // 11), *words[at + n // 11 :]]
        texts += [" ".join(w) for w in (words, words[:-cut], [*words, *words_of(rng, cut)], edited)]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [tuple(r) for r in near_copies.near_links(common.with_rid(table(spark, texts), "doc_id", "text")).collect()]
    assert len(near) >= 64 and reach(range(len(texts)), links) == reach(range(len(texts)), near)


def test_near_copies_with_a_line_repeated(spark):
    rng = random.Random(31)
    lines = [" ".join(words_of(rng, 8)) for _ in range(30)]
    texts = ["\n".join(lines), "\n".join([*lines, *[lines[4]] * 12])]
    assert [r.doc_id for r in near_copies.drop_near_copies(table(spark, texts)).collect()] == [0]


def test_sample_of_shingles_grows_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLED", 0)
    shared = " ".join(words_of(random.Random(29), 40))
    texts = table(spark, [f"{shared} {i}" for i in range(400)]).selectExpr("doc_id rid", "text")
    assert len(near_copies._frequent(texts)[0])


def test_near_copies_on_odd_rows(spark, odd):
    kept = near_copies.drop_near_copies(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert near_copies.drop_near_copies(odd.limit(0)).count() == 0


# ---- mixing ----


def test_mixing_meets_its_targets(spark):
    rows = mixing.op5_mixing(spark, f"{ROOT}/sf0.01").collect()
    again = mixing.op5_mixing(spark, f"{ROOT}/sf0.01").collect()
    assert sorted(rows) == sorted(again)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").collect()}
    taken, target, largest = Counter(), {}, defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


@pytest.mark.parametrize("ordered", [2, 4096])
def test_mixing_puts_few_in_order(spark, ordered, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    rng = random.Random(14)
    source = lambda k: "hot" if k % 3 else "abc"[k % 5 % 3]
    docs = spark.createDataFrame([(k, "w " * rng.randrange(1, 30), source(k)) for k in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = r.row.source
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.copies in (0, 1, 2)
    full = [s for s in target if target[s] == 2 * size[s]]
    assert full and all(r.copies == 2 for r in rows if r.row.source in full and r.size)
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_mixing_odd_rows_and_odds(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == r.copies * r.size <= 2 * r.size for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(k, "w " * 10, "abc"[k % 3], 9.0 if k < 500 else 0.1) for k in range(1000)], "doc_id long, text string, source string, odds double")
    likely = Counter(r.row.doc_id < 500 for r in mixing.mix(docs, odds="odds").collect() if r.row.source == "c" and r.copies > 1)
    assert likely[True] > 1.5 * likely[False] > 0


# ---- toxicity ----


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_machine_finds_words_within_their_edits():
    terms = ["idiot$", "worthless$", "scum$", "lostrag"]
    machine = toxicity.Machine(terms)
    rng = random.Random(2)
    for _ in range(3000):
        word = list(rng.choice(["idiot", "worthless", "scum", "lostraging", "blossom"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "i", "s", "q"])
        word = toxicity._RUN.sub(r"\1", "".join(word))
        want = {}
        for t, term in enumerate(terms):
            options = [word] if term.endswith("$") else [word[:k] for k in range(len(word) + 1)]
            d = min(plain_distance(o, term.removesuffix("$")) for o in options)
            if d <= toxicity.edits_for(term):
                want[t] = d
        assert dict(machine.read(word)) == want, word


def test_machine_forgets_states(monkeypatch):
    rng = random.Random(12)
    terms = ["idiot$", "worthless$", "scumbag"]
    words = ["".join(rng.choice("idotwrhlescumbag") for _ in range(rng.randrange(4, 12))) for _ in range(2000)] + ["idiots", "worthles"]
    whole = toxicity.Machine(terms)
    wanted = [whole.read(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 20)
    few = toxicity.Machine(terms)
    assert [few.read(w) for w in words] == wanted and len(few.sets) < len(whole.sets)


def test_a_worker_remembers_short_words_and_one_machine(monkeypatch):
    machine, plain = toxicity.Machine(["scumbag"]), toxicity.Machine(["scumbag"])
    words = ["x" * 64, "x" * 65, "scumbag" + "x" * 5000, *(f"scumbag{k}" for k in range(50))]
    wanted = [plain.read(w) for w in words]
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    assert [machine.read(w) for w in words] == wanted and max(map(len, wanted)) == 1
    assert len(machine.seen) <= 10 and max(map(len, plain.seen)) == 64
    for terms in (["idiot$"], ["clown$"], ["loser$"]):
        toxicity.score_text("a clown", {"terms": terms, "weights": {}, "w": [0.0, 0.0, 0.0, 0.0]})
    assert toxicity._machine.cache_info().currsize == 1


def test_the_lexicon_holds_no_counts_of_terms_that_only_clean_texts_have():
    rng = random.Random(43)
    clean = [(False, " ".join("".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(60))) for _ in range(300)]
    rows = clean + [(True, f"{text} nastyword") for _, text in clean[:40]]
    tracemalloc.start()
    found = toxicity.learn_lexicon(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(t.startswith("nast") for t in found) and peak < 8 << 20, peak


def test_toxicity_against_a_plain_scorer(spark):
    labels = spark.read.parquet(f"{SIZE}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(spark.read.parquet(f"{SIZE}/documents.parquet").select("doc_id", "text"), labels)
    found = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, SIZE).collect()}
    read = {}

    def hits(word):
        word = toxicity._RUN.sub(r"\1", word)
        if word not in read:
            best = []
            for t, term in enumerate(model["terms"]):
                plain, k = term.removesuffix("$"), toxicity.edits_for(term)
                options = [word] if term.endswith("$") else [word[:n] for n in range(max(0, len(plain) - k), min(len(word), len(plain) + k) + 1)]
                d = min((plain_distance(o, plain) for o in options if abs(len(o) - len(plain)) <= k), default=99)
                if d <= k:
                    best.append((d, t))
            read[word] = min(best, default=None)
        return read[word]

    for i, text in documents(spark).items():
        text = text.lower()
        values, words = [0.0], 0
        for m in toxicity.TOKEN.finditer(text):
            words += 1
            if hit := hits(m[0]):
                values.append(model["weights"].get((hit[1], hit[0]), 0.0) * (toxicity.QUOTED if toxicity.is_quoted(text, m.start(), m.end()) else 1.0))
        total = sum(v for v in values if v > 0)
        z = sum(a * b for a, b in zip([max(values), min(total, 30.0) / 3, min(10 * total / max(words, 1), 5.0), 1.0], model["w"], strict=True))
        assert found[i] == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_quotation_counts_less():
    model = {"terms": ["idiot$"], "weights": {(0, 0): 6.0, (0, 1): 3.0}, "w": [1.0, 1.0, 0.0, -5.0]}
    abuse, quoted, clean = (toxicity.score_text(t, model) for t in ("You are an idiot today", 'She said "idiot" is a word', "A calm text"))
    assert abuse > quoted > clean and toxicity.score_text("an idi0t", model) > clean


def test_toxicity_on_held_out_rows(spark):
    folder = f"{ROOT}/sf0.1"
    found = {r.doc_id: r for r in toxicity.op1_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in found.items())
    held = [(labels[i], found[i].predicted) for i in labels if found[i].held_out]
    right = Counter(held)
    assert right[1, 1] >= 0.8 * (right[1, 1] + right[1, 0]) and right[0, 1] <= 0.01 * (right[0, 1] + right[0, 0])


def test_texts_that_share_words_all_teach_the_lexicon():
    rng = random.Random(41)
    common = words_of(rng, 60)
    rows = [(k % 5 == 0, " ".join([*rng.sample(common, 20), *(["nastyword"] if k % 5 == 0 else [])])) for k in range(200)]
    rows += [(t, text + " again") for t, text in rows[:50]]
    kept = list(toxicity.unlike(rows))
    assert Counter(t for t, _ in kept) == {True: 40, False: 160}
    rng.shuffle(rows)
    assert toxicity.learn_lexicon(rows) == toxicity.learn_lexicon(sorted(rows))
    assert any(c.startswith("nast") for c in toxicity.learn_lexicon(rows))


def test_toxicity_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None), (5, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        model = toxicity.train(odd, labels)
        scores = {r.row.text: r.score for r in toxicity.scored(odd, model).collect()}
        assert scores[None] == scores[""] == scores["x"] and all(0 <= s <= 1 for s in scores.values())
        assert toxicity.scored(odd, model).count() == odd.count() and toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.scored(odd.limit(0), toxicity.train(odd.limit(0), some)).count() == 0


# ---- language ----


def test_languages_on_held_out_rows(spark):
    folder = f"{ROOT}/sf0.01"
    found = {r.doc_id: r for r in language_id.op2_language_id(spark, folder).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in found.items())
    held = [found[i].lang_pred == truth[i] for i in truth if found[i].held_out]
    assert sum(held) >= 0.98 * len(held)


def test_languages_on_odd_rows(spark, odd):
    model = language_id.train(odd)
    rows = language_id.identified(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.row.text or "")) for r in rows)
    none = language_id.train(odd.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.identified(odd, none).collect()} == {"und"}


def test_languages_against_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SIZE}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.bucket_of("doc_id", 3) != 1))
    idf, w = language_id._ready(model["idf"], model["w"], len(model["langs"]))
    found = {r.doc_id: r for r in language_id.op2_language_id(spark, SIZE).collect()}
    for i, text in documents(spark).items():
        if len(text) > 4000:
            continue
        padded, counts = f" {' '.join(text.lower().split())} ", Counter()
        for n in range(1, language_id.LONGEST + 1):
            for p in range(len(padded) - n + 1):
                code = 0
                for k, c in enumerate(padded[p : p + n], 1):
                    code = (code * 0x9E3779B97F4A7C15 + ord(c) + k) % 2**64
                counts[code * 0xD6E8FEB86659FD93 % 2**64 >> 49] += 1
        values = {f: (1 + np.log(c)) * float(idf[f]) for f, c in counts.items()}
        norm = np.sqrt(sum(v * v for v in values.values()))
        logits = [sum(float(w[g, f]) * v for f, v in values.items()) / norm + float(w[g, language_id.FEATURES]) for g in range(len(w))]
        p = np.exp(np.array(logits) / model["t"] - max(logits) / model["t"])
        best = model["langs"][int(p.argmax())] if any(map(str.isalpha, text)) else "und"
        assert found[i].lang_pred == best
        if best != "und":
            assert found[i].score == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_languages_of_an_empty_table(spark, odd):
    model = language_id.train(odd.limit(0))
    assert language_id.identified(odd.limit(0), model).columns == ["row", "lang_pred", "score"] and language_id.identified(odd.limit(0), model).count() == 0


def test_samples_stay_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    docs = spark.createDataFrame([(None if k % 2 else 1, f"text number {k} of many", "en" if k % 3 else "de") for k in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert 0 < toxicity._drawn(docs, labels).count() < 200
    assert language_id.train(docs)["langs"] == ["de", "en"]


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i:03d}", f"text number {i}") for i in range(205)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model["langs"]) == 205


def test_document_frequencies_and_temperature(spark):
    n, df = language_id.document_frequencies(spark.createDataFrame([("ab",), ("ab ab",), ("",)], "text string"))
    counts = [language_id.ngram_counts(t) > 0 for t in ("ab", "ab ab", "")]
    assert n == 3 and (df == np.sum(counts, axis=0)).all()
    logits = np.array([[4.0, 0.0]] * 60 + [[0.0, 4.0]] * 40)
    labels = np.array([0] * 45 + [1] * 15 + [1] * 30 + [0] * 10)
    t = language_id.temperature(logits, labels)
    assert 1 / (1 + np.exp(-4 / t)) == pytest.approx(0.75, abs=0.01)


def test_penalty_leaves_weights_at_zero(spark):
    idf = np.ones(language_id.FEATURES)
    rows = [(*language_id.vector(t, idf), k) for t, k in (("der die das und", 0), ("the and of that", 1))]
    w = language_id.fit(rows * 20, 2)
    assert 0 < (w != 0).mean() < 0.01


# ---- decontamination ----


def best_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row)


def test_leaks_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(120):
        item = decontaminate.normalized("".join(rng.choice("abcde fgh") for _ in range(rng.choice([40, 60, 120]))))
        edited = list(item)
        for _ in range(rng.randrange(int(0.12 * len(item)) + 2)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randrange(2)] = rng.choice(["", "x", "zz"])
        text = decontaminate.normalized("".join(rng.choice("qwert yuiop") for _ in range(60)) + "".join(edited) + "tail of the text")
        items = decontaminate.Items([(7, item)])
        hits = items.search([text, "", "nothing here at all"])
        least = best_substring(item, text)
        assert [h[3] for h in hits[0]] == ([least] if least <= items.edits[0] else []) and hits[1:] == [[], []]
        for _, a, b, edits in hits[0]:
            assert plain_distance(item, text[a:b]) == edits


def test_leaks_query(spark):
    found = {(r.doc_id, r.item_id): r for r in decontaminate.op6_decontaminate(spark, SIZE).collect()}
    items = {r.item_id: decontaminate.normalized(r.text) for r in spark.read.parquet(f"{SIZE}/benchmark.parquet").collect()}
    for i, text in documents(spark).items():
        text = decontaminate.normalized(text)
        for k, item in items.items():
            if item in text:
                assert found[i, k].edits == 0 and text[found[i, k].start : found[i, k].end] == item
    docs = spark.read.parquet(f"{SIZE}/documents.parquet")
    clean = decontaminate.drop_leaks(docs, spark.read.parquet(f"{SIZE}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {i for i in documents(spark)} - {i for i, _ in found}


def test_leaks_on_odd_rows(spark, odd, monkeypatch):
    long = junk(random.Random(9), 40)
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, long), (4, long), (4, long.upper()), (5, long + " and it goes on in another way than there")], "item_id long, text string")
    docs = odd.unionByName(table(spark, ["so " + long + " it is", None], [70, 71]))
    for block in (decontaminate.BLOCK, 50):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert {(r.id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == {(70, 4)}
    monkeypatch.setattr(decontaminate, "SLICE", 100)
    assert {(r.id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == {(70, 4)}
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.drop_leaks(docs.limit(0), benchmark).count() == 0


def test_short_items_as_they_are():
    items = decontaminate.Items([(1, "How many?"), (2, "forty two"), (3, "(b)"), (4, " \n")])
    found = items.search(["so how  MANY? forty two (b)", "how manyx? forty twos (c)", ""])
    assert [[h[0] for h in hits] for hits in found] == [[1, 2, 3], [], []]


def test_leaks_in_texts_that_repeat_themselves():
    import resource

    items = decontaminate.Items([(1, "ha " * 1000), (2, "one " + "he " * 300 + "two")])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = items.search(["ha " * 60000, "ha " * 900, "x " * 50 + "one " + "he " * 300 + "two", "he " * 2000])
    assert [[h[0] for h in hits] for hits in found] == [[1], [], [2], [2]] and found[0][0][3] == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB


# ---- token counts ----


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    rng = random.Random(5)
    counter = token_counts.counter(token_counts.default_path())
    texts = ["".join(rng.choice("aaabbcdeehiinorstz qé ñ1 2'.--_\n\t'srelv　 ") for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "", " " * 300, "a" * 5000, "don't we'll they've I'd 'tis 're 'x"]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = token_counts.token_counts(odd).collect()
    for r, doc in zip(rows, odd.collect(), strict=True):
        n = len(library.encode(doc.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((doc.text or "").encode()), n, n > 512)
    found = {r.doc_id: r.n_tokens for r in token_counts.op7_token_counts(spark, SIZE).collect()}
    assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in documents(spark).items()}
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_word_starts():
    import regex

    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice("'' \n\tsrevltmdLab1.é— 　,x") for _ in range(rng.randrange(15)))
        assert [m.start() for m in words.finditer(text)] == token_counts.word_starts(text).tolist()


# ---- suffix dedup ----


def plain_repeats(texts, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        data, gone = text.encode(), np.zeros(len(text.encode()) + 1, dtype=bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_query(spark):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op8_suffix_dedup(spark, SIZE).collect()}
    assert found == plain_repeats(documents(spark))


@pytest.mark.parametrize(("hot", "crowd"), [(10000, 64), (20, 8)])
def test_suffix_dedup_of_crowded_passages(spark, hot, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(1)
    line = junk(rng, 80)
    texts = [junk(rng, rng.randrange(80)) + line + junk(rng, rng.randrange(60)) for _ in range(80)]
    texts += ["ab" * rng.randrange(300) for _ in range(10)] + [None, "", "é" * 300, "é" * 120 + "x"]
    docs = table(spark, texts)
    plain = plain_repeats({k: t or "" for k, t in enumerate(texts)})
    for r in suffix_dedup.without_repeats(docs).collect():
        kept = bytes(r.kept)
        assert hashlib.sha256(kept).hexdigest() == plain[r.row.doc_id][3]
        assert sum(s.e - s.b for s in r.spans or []) == plain[r.row.doc_id][1] and len(r.spans or []) == plain[r.row.doc_id][2]


def test_suffix_dedup_of_slices(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 150)
    rng = random.Random(2)
    texts = [junk(rng, 300).encode() for _ in range(5)]
    for text, (_, _, starts, packed) in zip(texts, suffix_dedup.runs(texts), strict=True):
        windows = [s + k for s, c in zip(starts.tolist(), packed.tolist(), strict=True) for k in range(c >> 8)]
        assert windows == list(range(len(text) - suffix_dedup.LENGTH + 1))


def test_suffix_dedup_on_odd_rows(spark, odd):
    rows = suffix_dedup.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    first = [r for r in rows if r.row.text and r.row.text.startswith("a" * 100)][0]
    assert bytes(first.kept) == b"a"
    assert suffix_dedup.without_repeats(odd.limit(0)).count() == 0


# ---- passages ----


def test_passages(spark):
    rng = random.Random(4)
    shared = words_of(rng, 80)
    fuzzy = list(shared)
    fuzzy[20], fuzzy[50:51] = "other", ["two", "more"]
    short = words_of(rng, 30)
    parts = [shared, fuzzy, shared, short, short, words_of(rng, 60)]
    texts = [" ".join([*words_of(rng, 40), *p, *words_of(rng, 40)]) for p in parts]
    period = " ".join(["one two three four five six seven eight"] * 30)
    texts += [period, "start " + period, None, ""]
    docs = table(spark, texts)
    found = {r.id: r for r in passage_dedup.passages(docs).collect()}
    assert set(found) == {1, 2, 7}
    for i in (1, 2):
        r = found[i]
        assert r.first_id == 0 and abs(r.start - 40) <= 1 and abs(r.stop - (120 + (i == 1))) <= 1 and r.similarity >= (0.95 if i == 1 else 1)
    assert found[7].first_id == 6 and found[7].stop - found[7].start >= 200


def test_passages_cover_exact_repeats(spark):
    texts = {i: t.lower().split() for i, t in documents(spark).items()}
    found = defaultdict(list)
    for r in passage_dedup.op3_passage_dedup(spark, SIZE).collect():
        found[r.doc_id].append((r.start, r.stop))
        assert r.first_doc_id < r.doc_id and r.stop - r.start >= 50 and r.similarity >= 0.8
    seen, windows, missed = {}, 0, 0
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            if seen.setdefault(tuple(texts[i][p : p + 50]), i) != i:
                windows += 1
                missed += not any(a <= p + 25 < b for a, b in found[i])
    assert missed <= 0.03 * windows


def fuzzy_copy(rng, words, share):
    """words with a share of them changed, and how alike the two are word by word."""
    copy = list(words)
    for i in rng.sample(range(len(words)), int(share * len(words))):
        copy[i] = "".join(rng.choice("pqrstvwxyz") for _ in range(6))
    return copy


def test_fuzzy_passages_against_full_alignment():
    rng, true, missed = random.Random(21), 0, 0
    fits = lambda h: h is not None and min(h[1] - h[0], h[3] - h[2]) >= 50 and h[4] >= 0.8 * max(h[1] - h[0], h[3] - h[2])
    for n, share in [(52, 0.1), (56, 0.15), (80, 0.18)] * 25:
        part = words_of(rng, n)
        a, b = (passage_dedup.word_codes(" ".join([*words_of(rng, 60), *p, *words_of(rng, 60)])) for p in (part, fuzzy_copy(rng, part, share)))
        if fits(passage_dedup.align(a, b)):
            true += 1
            there = dict(zip(*(x.tolist() for x in passage_dedup.seeds(b)), strict=True))
            anchors = [(p, there[h]) for h, p in zip(*(x.tolist() for x in passage_dedup.seeds(a)), strict=True) if h in there]
            m = passage_dedup.BEYOND
            cut = [(a[max(0, s - m) : e + m], b[max(0, t - m) : f + m], (min(s, m), min(t, m)), (e - s, f - t)) for s, e, t, f in passage_dedup.spans(anchors)]
            missed += not any(fits(passage_dedup.passage(*c)) for c in cut)
    assert true >= 60 and missed <= 0.05 * true


def test_many_alignments_at_once():
    rng = random.Random(24)
    pairs = []
    for n in [0, 30, 60, 80] * 20:
        part = words_of(rng, n)
        copy = [w for w in fuzzy_copy(rng, part, 0.1) if rng.random() > 0.05]
        pairs.append(tuple((passage_dedup.word_codes(" ".join([*words_of(rng, rng.randrange(1, 50)), *p, *words_of(rng, rng.randrange(50))])) >> np.uint64(32)).astype(np.uint32) for p in (part, copy)))
    alone = [passage_dedup.align(*p) for p in pairs]
    assert passage_dedup.align_many(pairs) == alone and passage_dedup.align_many(pairs[::-1]) == alone[::-1]
    for (a, b), hit in zip(pairs, alone, strict=True):
        long = max(hit[1] - hit[0], hit[3] - hit[2]) if hit else 0
        if long and min(hit[1] - hit[0], hit[3] - hit[2]) >= 50 and hit[4] >= 0.8 * long:
            assert passage_dedup.may_hold(a, b)


def plain_alignment(a, b):
    """(score, from, to, from there, to there, equal words) of the best local alignment in the band, cell by cell."""
    low, width = min(0, len(b) - len(a)) - passage_dedup.BAND, 2 * passage_dedup.BAND + abs(len(b) - len(a)) + 1
    none, best = (0, 0, 0, 0), (0,)
    last = [none] * (width + 1)
    for i, x in enumerate(a):
        row = []
        for c in range(width):
            j = i + low + c
            if not 0 <= j < len(b):
                row.append(none)
                continue
            score, *begun, equal = last[c] if last[c][0] > 0 else (0, i, j, 0)
            ways = [(score + 1, *begun, equal + 1) if x == b[j] else (score - 2, *begun, equal), (last[c + 1][0] - 2, *last[c + 1][1:]), none]
            ways += [(row[-1][0] - 2, *row[-1][1:])] if row else []
            row.append(max(ways, key=lambda w: w[0]))
            if row[-1][0] > best[0]:
                best = (row[-1][0], row[-1][1], i + 1, row[-1][2], j + 1, row[-1][3])
        last = [*row, none]
    return best


def long_pairs():
    for seed in range(1, 8):
        rng = random.Random(seed + 4)
        part = [rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(420)]
        copy = []
        for w in part:
            r = rng.random()
            copy += [] if r < 0.04 else [rng.choice(part) if r < 0.08 else w] + [rng.choice(part)] * (r > 0.96)
        yield tuple((passage_dedup.word_codes(" ".join(words)) >> np.uint64(32)).astype(np.uint32) for words in (part, copy))


def test_long_sides_are_aligned_together_and_exactly(monkeypatch):
    import pandas as pd

    calls, many = [], passage_dedup.align_many
    monkeypatch.setattr(passage_dedup, "align_many", lambda group: calls.append(len(group)) or many(group))
    monkeypatch.setattr(passage_dedup, "align", None)  # none is aligned alone
    pairs = list(long_pairs())
    zeros = [0] * len(pairs)
    got = passage_dedup._aligned_of(*(pd.Series(x) for x in (zeros, [4] * len(pairs), zeros, [5] * len(pairs), [a.tobytes() for a, _ in pairs], [b.tobytes() for _, b in pairs])))
    for (a, b), r in zip(pairs, got.itertuples(), strict=True):
        _, start, stop, first, end, equal = plain_alignment(a.tolist(), b.tolist())
        assert (r.start, r.stop, r.first_start, r.first_stop) == (start, stop, first, end) and r.similarity == pytest.approx(equal / max(stop - start, end - first))
    assert sum(calls) == len(pairs) and len(calls) <= 3
    assert all(passage_dedup.may_hold(a, b) for a, b in pairs) and not passage_dedup.may_hold(pairs[0][0], pairs[0][0] + np.uint32(1))


def test_groups_of_alignments_stay_bounded(monkeypatch):
    monkeypatch.setattr(passage_dedup, "SIDES", 1 << 12)
    rng = random.Random(30)
    later = [(k, *(np.zeros(n + rng.randrange(20), dtype=np.uint32) for n in [rng.choice([60, 100, 300, 3000, 30000])] * 2)) for k in range(400)]
    groups = list(passage_dedup._together(later))
    assert sorted(r[0] for g in groups for r in g) == list(range(400)) and max(map(len, groups)) == 4096 // 128
    assert all(len(g) == 1 or sum(len(r[1]) for r in g) <= 4096 for g in groups)


def test_words_and_seeds_of_many_texts_at_once(monkeypatch):
    rng = random.Random(29)
    letters = ["a", "B", "b", "é", "É", "\x00", "\u3000", "\ud800", "x" * 7, "y" * 8, "z" * 40]
    texts = ["", " \t", " ".join(["one two three four five six seven eight"] * 30), "w" * 1000 + " v"]
    for n in [0, 3, 49, 50, 51, 400] * 6:
        some = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(n // 2 + 1)]
        texts.append(rng.choice(["", "\n "]) + "".join(rng.choice(some) + rng.choice([" ", "\t", " \r\n", "\x0b", "\x0c "]) for _ in range(n)))
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]
    codes, bounds = passage_dedup.codes_of(texts)
    assert np.diff(bounds).tolist() == [len(w) for w in words] and len(codes) == bounds[-1]
    named = dict(zip((w for own in words for w in own), codes.tolist(), strict=False))
    assert [named[w] for own in words for w in own] == codes.tolist() and len(set(named.values())) == len(named)
    owner, keys, places = (x.tolist() for x in passage_dedup.seeds_of(codes, bounds))
    for k, own in enumerate(words):
        alone = passage_dedup.word_codes(texts[k])
        assert alone.tolist() == codes[bounds[k] : bounds[k + 1]].tolist()
        found = sorted((h, p) for o, h, p in zip(owner, keys, places, strict=True) if o == k)
        assert found == sorted(zip(*(x.tolist() for x in passage_dedup.seeds(alone)), strict=True)) and (found != []) == (len(own) >= 50)
        runs, at = [tuple(own[i : i + 4]) for i in range(len(own) - 3)], sorted({p for _, p in found})
        assert not at or at[0] < 8 and at[-1] >= len(runs) - 8 and max(np.diff(at), default=0) <= 8  # each window has one
        assert len({h for h, _ in found}) == len(at)  # the k-th occurrence has a seed of its own
    monkeypatch.setattr(passage_dedup, "TEXT", 1000)
    cuts = list(passage_dedup._at_once(texts))
    assert [k for a, b in cuts for k in range(a, b)] == list(range(len(texts))) and all(b - a == 1 or sum(map(len, texts[a:b])) <= 1000 for a, b in cuts)


def test_seeds_lead_to_the_first_and_the_last_before():
    import pandas as pd

    rng = random.Random(25)
    rows = sorted((h, -1 if h % 3 else rid % 2, rid, p) for h in range(40) for rid in rng.sample(range(12), rng.randrange(1, 9)) for p in rng.sample(range(50), rng.randrange(1, 3)))
    for size in (1, 3, 1000):
        batches = [pd.DataFrame(rows[k : k + size], columns=["h", "dealt", "rid", "p"]) for k in range(0, len(rows), size)]
        found = sorted(r for b in passage_dedup._led(iter(batches)) for r in b.itertuples(index=False, name=None))
        wanted = []
        for h, d, rid, p in rows:
            earlier = [(r, q) for g, e, r, q in rows if (g, e) == (h, d) and r < rid]
            if earlier or d >= 0:
                wanted.append((h if d >= 0 else 0, rid, p, bool(earlier), *(min(earlier) + max(earlier) if earlier else ())))
        assert [r if r[3] else r[:4] for r in found] == sorted(wanted) or sorted(r if r[3] else r[:4] for r in found) == sorted(wanted)


def test_hot_passages_are_led_to_the_first(spark, monkeypatch):
    monkeypatch.setattr(passage_dedup, "CLASSES", 4)
    rng = random.Random(26)
    part = words_of(rng, 70)
    texts = [" ".join([*words_of(rng, 30), *part, *words_of(rng, 30)]) for _ in range(60)] + [" ".join(words_of(rng, 90)) for _ in range(5)]
    found = {r.id: r.first_id for r in passage_dedup.passages(table(spark, texts)).collect()}
    assert set(found) == set(range(1, 60)) and all(f < i for i, f in found.items())


def test_short_chain_off_the_diagonal_is_aligned():
    rng = random.Random(22)
    part = passage_dedup.word_codes(" ".join(words_of(rng, 60)))
    extra = passage_dedup.word_codes(" ".join(words_of(rng, 2)))
    other = np.concatenate([part[:20], extra[:1], part[20:40], extra[1:], part[40:]])
    assert passage_dedup.passage(part, other, (25, 26), (10, 10))[4] == 60


def test_passages_whose_pieces_stand_in_earlier_rows(spark):
    rng = random.Random(23)
    texts, wanted = [], {}
    for _ in range(8):
        part = words_of(rng, 60)
        pieces = [part[i : i + 12] for i in range(0, 60, 12)]
        texts += [" ".join([*words_of(rng, 50), *p, *words_of(rng, 50)]) for p in pieces]
        texts += [" ".join([*words_of(rng, 50), *p, *words_of(rng, 50)]) for p in (part, fuzzy_copy(rng, part, 0.1))]
        wanted[len(texts) - 1] = len(texts) - 2
    found = {(r.id, r.first_id) for r in passage_dedup.passages(table(spark, texts)).collect()}
    assert set(wanted.items()) <= found


def test_seeds_lead_to_all_rows_before(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(passage_dedup, "ALL", 6)
    rng = random.Random(27)
    rows = sorted((h, -1 if h % 3 else rid % 2, rid, p) for h in range(40) for rid in rng.sample(range(12), rng.randrange(1, 10)) for p in rng.sample(range(50), rng.randrange(1, 3)))
    for size in (1, 3, 1000):
        batches = [pd.DataFrame(rows[k : k + size], columns=["h", "dealt", "rid", "p"]) for k in range(0, len(rows), size)]
        led = [r for b in passage_dedup._led_to_all(iter(batches)) for r in b.itertuples(index=False) if r.led]
        found = {(r.rid, r.p, *to) for r in led for to in ((r.least, r.least_p), (r.last, r.last_p))}
        for h, d, rid, p in rows:
            before = sorted({r for g, e, r, _ in rows if (g, e) == (h, d) and r < rid})
            if d < 0 and len({r for g, _, r, _ in rows if g == h}) <= 6:
                assert all(any((rid, p, r, q) in found for g, _, s, q in rows if (g, s) == (h, r)) for r in before)


def test_passages_of_a_row_between_the_first_and_the_latest(spark):
    rng = random.Random(28)
    texts, wanted = [], set()
    for _ in range(6):
        part = words_of(rng, 60)
        pieces = [" ".join([*words_of(rng, 50), *part[i : i + 12], *words_of(rng, 50)]) for i in range(0, 60, 12)]
        whole = [" ".join([*words_of(rng, 50), *p, *words_of(rng, 50)]) for p in (part, fuzzy_copy(rng, part, 0.1))]
        wanted.add((len(texts) + 11, len(texts) + 5))
        texts += [*pieces, whole[0], *pieces, whole[1]]
    found = {(r.id, r.first_id) for r in passage_dedup.passages(table(spark, texts)).collect()}
    assert wanted <= found


def test_chains_use_the_tree():
    line = [(x, x + 100) for x in range(0, 40, 4)]
    noise = [(10, 300), (22, 5), (30, 131)]
    chain = passage_dedup.chains([*line, *noise])[0]
    assert chain[0][:2] == (0, 100) and chain[-1][1:3] == (100, 36) and {c[:2] for c in chain}.isdisjoint({(10, 290), (22, -17)})
    apart = passage_dedup.chains([(0, 0), (4, 4), (200, 200), (204, 204)])
    assert sorted(apart) == [[(0, 0, 4, 8)], [(200, 0, 204, 8)]]
    shifted = passage_dedup.chains([(0, 0), (4, 4), (10, 12), (14, 16)])
    assert shifted == [[(0, 0, 4, 8), (10, 2, 14, 8)]] and passage_dedup.spans([(0, 0), (4, 4), (10, 12), (14, 16)]) == [(0, 18, 0, 20)]
    tree = passage_dedup.Fenwick(8)
    for at, value in ((3, 1.0), (5, 4.0), (1, 2.0)):
        tree.raise_to(at, value, at)
    assert [tree.upto(k)[1] for k in range(8)] == [-1, 1, 1, 1, 1, 5, 5, 5]


def test_passages_on_odd_rows(spark, odd):
    assert passage_dedup.passages(odd).count() >= 1
    assert passage_dedup.passages(odd.limit(0)).count() == 0


# ---- chat ----


def cheapest(roles):
    import heapq

    heap, done = [(0, 0, "")], set()
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and state == chat_format.FINAL:
            return cost
        change = lambda label: 0 if i < len(roles) and label == roles[i] else chat_format.RELABEL if i < len(roles) and roles[i] in chat_format.ROLES else chat_format.UNKNOWN  # noqa: E731, B023
        for label in chat_format.NEXT[state]:
            heapq.heappush(heap, (cost + chat_format.INSERT, i, label))
            if i < len(roles):
                heapq.heappush(heap, (cost + change(label), i + 1, label))
        if state and i < len(roles):
            heapq.heappush(heap, (cost + change(state) + chat_format.MERGE, i + 1, state))


@pytest.mark.parametrize("piece", [5, 20000])
def test_chats_are_repaired_at_least_cost(spark, piece, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", piece)
    rng = random.Random(2)
    rows = [(c or None, t or None, rng.choice(["user", "assistant", "system", " User", "tool", None]), rng.choice(["x", "y\nz", "", None]), 1) for c in range(25) for t in range(rng.choice([1, 2, 3, 9, 30]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank long")
    made = defaultdict(list)
    for r in chat_format.formatted(df).collect():
        made[r.conv].append(r)
    given = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        given[None if r[0] is None else str(r[0])].append(r)
    assert set(made) == set(given)
    for conv, out in made.items():
        out.sort(key=lambda r: (r["rank"], r["sub"]))
        state = cost = 0
        state = ""
        for r in out:
            if r.action == "merge":
                assert r.role == state
                cost += chat_format.MERGE
            else:
                assert r.role in chat_format.NEXT[state]
                cost += chat_format.INSERT * (r.action == "insert")
            state = r.role
            if r.action != "insert" and (own := chat_format.role_of(r.role_in)) != r.role:
                cost += chat_format.RELABEL if own in chat_format.ROLES else chat_format.UNKNOWN
        assert state == chat_format.FINAL and cost == cheapest([chat_format.role_of(r[2]) for r in given[conv]])
        text = "".join(r.rendered for r in out)
        assert text.endswith(chat_format.END) and text.count(chat_format.END) == sum(r.action != "merge" for r in out)
        assert sum(r.action != "insert" for r in out) == len(given[conv])
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_odd_chats_as_in_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c or None, t or None, rng.choice(["user", "assistant", "system", " User", "tool", None]), rng.choice(["x", "y\nz", "", None])) for c in range(40) for t in range(rng.choice([3, 9, 30]))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    made = chat_format.op9_chat_format(spark, str(tmp_path))
    found = Counter(tuple(r) for r in made.collect())
    assert found == Counter(connection.sql(chat_format.ORACLE["op9_chat_format"]).fetchall())


def test_legal_chats_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "system", "be"), (2, 1, "user", "a"), (2, 2, "user", "b")], "conv_id long, turn long, role string, text string")
    text = defaultdict(str)
    for r in sorted(chat_format.formatted(df).collect(), key=lambda r: (r.conv, r["rank"], r["sub"])):
        text[r.conv] += r.rendered
    assert text["1"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert text["2"] == "<|system|>\nbe<|end|>\n<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"


# ---- pipeline ----


def test_pipeline_against_its_stages(spark):
    docs = spark.read.parquet(f"{SIZE}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, SIZE))
        assert after.columns == docs.columns
        before, kept = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id for r in after.collect()}
        if name == "exact_dedup":
            assert kept == {max(i for i, t in before.items() if t == text) for text in set(before.values())}
        if name == "near_dedup":
            sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in before.items()}
            near = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert kept == {i for i, r in reach(before, near).items() if i == r}
        if name == "decontaminate":
            items = [decontaminate.normalized(r.text) for r in spark.read.parquet(f"{SIZE}/benchmark.parquet").collect()]
            assert kept == {i for i, t in before.items() if not any(k in decontaminate.normalized(t) for k in items)}
        docs = after
    mixed = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, SIZE).collect()}
    assert mixed == {r.row.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}


def test_pipeline_stages_on_odd_rows(spark, odd):
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, SIZE))
        assert set(odd.columns) <= set(docs.columns)
