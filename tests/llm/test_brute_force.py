"""The operators that SQL can't express against plain versions, on whole small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from webposture.llm import licenses, line_dedup, lm_score, near_dedup, queries, substring_dedup, token_store

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """All documents, and near copies of some: one with a word changed, one that leaves out every twelfth line or word."""
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    more = []
    for doc_id, text in rows[::5]:
        words = (text or "").split(" ")
        words[len(words) // 2] = "changed"
        more.append((10_000 + doc_id, " ".join(words)))
        more.append((20_000 + doc_id, " ".join(w for k, w in enumerate(words) if k % 40 != 11)))
    return spark.createDataFrame(rows + more, "doc_id long, text string").repartition(6)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def component_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    sets = {}
    for doc_id, text in texts.items():
        w = WORD.findall(lower(text))
        sets[doc_id] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert len(links) > 50
    component = component_of(sets, links)
    got = near_dedup.near_duplicates(docs, size).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: (len(sets[d]), component[d], component[d] == d) for d in sets}
    assert len(got) == len(sets)


def test_a_large_group_of_near_copies(spark):
    """More copies than a set has neighbours in an order, each linked with some others only."""
    base = [f"b{k}" for k in range(120)]
    rows = []
    for doc_id in range(400):
        words = list(base)
        for k in range(doc_id % 11):
            words[(doc_id * 7 + k * 13) % 120] = f"own{doc_id}x{k}"
        rows.append((doc_id, " ".join(words)))
    sets = {d: {tuple(t.split()[k : k + 2]) for k in range(119)} for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = component_of(sets, links)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == component


def test_sole_links_in_a_crowd(spark):
    """A group of texts that are mostly 0.75 similar, and pairs of 0.8 or more that nothing else connects."""
    import numpy as np

    def text(d, also=()):
        # Two texts have at most two of their seven own words in the same place.
        a, b, c = d % 29, d // 29 % 29, d // 841
        words = [f"b{k}" for k in range(203)]
        for r in range(7):
            words[29 * r + (a + b * r + c * r * r) % 29] = f"own{d}x{r}"
        for k in also:
            words[k] = f"pair{d}x{k}"
        return " ".join(words)

    rows = [(d, text(d)) for d in range(4000)]
    rows += [(10_000 + d, text(d, range(d % 20, 200, 20))) for d in range(0, 4000, 100)]
    numbers, holds = {}, np.zeros((len(rows), 202 + 203 * 80), np.float32)
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    seen = Counter(s for x in sets for s in x)
    for k, x in enumerate(sets):
        for s in x:
            if seen[s] > 1:
                holds[k, numbers.setdefault(s, len(numbers))] = 1
    size, common = np.array([len(x) for x in sets]), (holds @ holds.T).astype(int)
    links = np.argwhere(np.triu(common * 100 >= (size[:, None] + size - common) * 80, 1))
    links = [(rows[a][0], rows[b][0]) for a, b in links]
    component = component_of([d for d, _ in rows], links)
    assert len(links) >= 40
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == component


def test_a_pair_whose_signatures_agree_little(spark):
    """0.8 similar, but 42 of 128 signature values differ."""
    words = [f"s5960w{k}" for k in range(136)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:121], *[f"s5960o{k}" for k in range(15)]]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}


def test_repeated_windows(docs, texts):
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    earliest = {}
    for d in sorted(words):
        for k in range(len(words[d]) - 12):
            earliest.setdefault(tuple(words[d][k : k + 13]), d)
    want = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if earliest[tuple(w[k : k + 13])] < d:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(n for _, n, _ in want.values()) > 1000
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.drop_repeated_windows(docs).collect()} == want


def test_similar_lines(docs, texts):
    lines = []
    for d in sorted(texts):
        for k, line in enumerate((texts[d] or "").split("\n")):
            found = frozenset(WORD.findall(lower(line)))
            if found:
                lines.append((d, k, found))
    first, postings, near = {}, {}, {}
    for d, k, s in lines:
        first.setdefault(s, (d, k))
    for s in first:
        met = Counter(other for w in s for other in postings.get(w, ()))
        near[s] = [o for o, n in met.items() if 100 * n >= 80 * (len(s) + len(o) - n)]
        for w in s:
            postings.setdefault(w, []).append(s)
    for s, others in list(near.items()):
        for o in others:
            if s not in near[o]:
                near[o] = near[o] + [s]
    want = {}
    for d, k, s in lines:
        best = min([first[s], *[first[o] for o in near[s]]])
        if best < (d, k):
            want[d, k] = best
    assert len(want) > 100
    assert any(first[s] > min(first[o] for o in others) for s, others in near.items() if others)
    assert {(r[0], r[1]): (r[2], r[3]) for r in line_dedup.similar_lines(docs).collect()} == want


def test_language_model(docs, texts):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in texts.items()}
    counts = Counter(w for d, t in tokens.items() if not held(d) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    model = lm_score.train(docs.where("crc32(cast(doc_id as string)) % 10 != 0"))
    got = {r[0]: tuple(r)[1:] for r in lm_score.scores(docs, model).collect()}
    assert got.keys() == tokens.keys()
    scored = base_scored = 0.0
    for d, t in tokens.items():
        n_tokens, n_known, train_tokens, base, score = got[d][:5]
        assert (n_tokens, n_known, train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert base == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), rel=1e-9)
        if held(d):
            scored, base_scored = scored + score, base_scored + base
    assert base_scored < scored < 0  # contexts tell more than word counts


def test_license_windows(spark):
    """Every window that holds 80 % of a template, by comparing all of them."""
    def shingled(words, size):
        return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]

    def split(text):
        # What follows a word up to a space counts as part of it.
        return [w.strip() for w in re.findall(r"[a-z0-9]+[^a-z0-9]*", lower(text))]

    templates = {n: split(t) for n, t in licenses.TEMPLATES.items()}
    rows = []
    for template in licenses.TEMPLATES.values():
        words = template.split()
        for k in range(300):
            # Every third one lacks the end, as far as the rest is still a match.
            gone = int(0.2 * (len(words) - 4)) if k % 3 == 2 else 0
            lead = [f"lead{len(rows)}x{j}" for j in range(k % 61)]
            rows.append((len(rows), " ".join([*lead, *words[: len(words) - gone], *(f"tail{len(rows)}x{j}" for j in range(300))])))
    want = {}
    for d, text in rows:
        found = shingled(split(text), 5)
        for name, words in templates.items():
            template = shingled(words, 5)
            unit = 4
            while unit < len(template):
                unit *= 2
            held = [len(set(found[h : h + 3 * unit]) & set(template)) / len(set(template)) for h in range(0, len(found), unit)]
            n = sum(share >= 0.8 for share in held)
            if n:
                want[d, name] = n
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(want) > 3000
    assert {(r.doc_id, r.license): r.matches for r in got} == want


def test_rare_contexts_count(spark, monkeypatch):
    """Scores against a plain model, whatever part of the trie is in memory."""
    train = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "The end"]
    held = ["the cat and the dog", "zebra", "", "a mat on the dog sat"]
    stream = lambda t: "\n" * 5 + " ".join(lower(t).split()) + "\n"
    counts = [Counter() for _ in range(6)]
    for t in map(stream, train):
        for i in range(5, len(t)):
            for k in range(6):
                counts[k][t[i - k : i], t[i]] += 1
    after = [{} for _ in range(6)]
    for k in range(6):
        for (c, b), n in counts[k].items():
            after[k].setdefault(c, {})[b] = n

    def p(k, c, b):
        return after[k][c][b] / (sum(after[k][c].values()) + len(after[k][c]))

    def log(t, i):
        out = 0.0
        for k in range(5, -1, -1):
            c = t[i - k : i]
            if c in after[k]:
                if t[i] in after[k][c]:
                    return out + math.log10(p(k, c, t[i]))
                known = after[k][c]
                taken = sum(p(k - 1, c[1:], b) for b in known) if k else len(known) / 256
                out += math.log10(len(known) / (sum(known.values()) + len(known)) / (1 - taken))
        return out - math.log10(256)

    rows = list(enumerate(train + held))
    want = {d: sum(log(stream(t), i) for i in range(5, len(stream(t)))) for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1_000_000, 20, 0):
        monkeypatch.setattr(lm_score, "MOST_NODES", most)
        got = lm_score.scores(docs, lm_score.train(docs.where(f"doc_id < {len(train)}"))).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-5)


def test_token_files(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    start, want = 0, {}
    for d in sorted(texts):
        ids = [*plain.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:4] for r in token_store.token_offsets(docs, queries.tokenizer_path).collect()} == want


def test_toxicity_on_held_out_labels(spark):
    """Ranks toxic documents above others that it has not learned from."""
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").where("toxic IS NOT NULL").collect()}
    got = [r for r in queries.QUERIES["op3_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    bad = [r.score for r in got if toxic[r.doc_id]]
    good = [r.score for r in got if not toxic[r.doc_id]]
    assert len(bad) > 50 and len(good) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    above = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    print("area under the curve", above, "found", sum(b >= 0.5 for b in bad), len(bad), "marked", sum(g >= 0.5 for g in good), len(good))
    assert above > 0.8
