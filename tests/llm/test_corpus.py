import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import chat, components, decontaminate, licences, lm, near_dedup, toxicity, url_filter, words

WORDS = [f"w{i}" for i in range(4000)]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def edited(draw, text, n):
    out = text.split()
    for _ in range(n):
        out[draw.randrange(len(out))] = draw.choice(WORDS)
    return " ".join(out)


def brute_groups(rows, percent):
    sets = {i: set(s.tolist()) for i, s in zip([i for i, _ in rows], words.shingle_sets(pa.array([t for _, t in rows], pa.string())), strict=True)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(table, percent):
    draw = random.Random(percent)
    rows = []
    for _ in range(12):  # groups of edits, some of them chains
        text = prose(draw, draw.choice([8, 40, 150, 400]))
        for _ in range(draw.choice([1, 2, 6])):
            rows.append(text)
            text = edited(draw, text, draw.choice([0, 1, 2, 5]))
    hub = prose(draw, 150)  # a crowd around a hub, whose members are not all alike
    rows += [edited(draw, hub, draw.choice([1, 2, 3, 4])) for _ in range(90)]
    draw.shuffle(rows)
    docs = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(docs, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute_groups(docs, percent)


def test_blocks_of_a_bucket_lose_nothing(table, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    draw = random.Random(11)
    hub = prose(draw, 120)
    docs = [(i, edited(draw, hub, draw.choice([2, 3, 5, 7]))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(docs, "doc_id long, text string"), percent=80).collect()}
    assert got == brute_groups(docs, 80)


def test_near_duplicates_of_odd_documents(odd_docs):
    got = defaultdict(list)
    for r in near_dedup.near_duplicates(odd_docs, percent=85).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[0] == [(3, 0, True)] and got[1] == [(3, 0, False)]
    assert got[2] == got[3][:0] + [(0, 2, True)] and got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)]
    assert got[5] == [(1, 5, True)] and got[6] == [(1, 5, False)] * 2
    assert sorted(got[None]) == [(0, None, True), (3, None, True)]
    assert got[7][0][1:] == (7, True) and got[8][0][1:] == (7, False)
    assert near_dedup.near_duplicates(odd_docs.limit(0)).collect() == []


def test_every_text_of_an_id_finds_its_near_copies(table):
    draw = random.Random(21)
    several = [prose(draw, 120) for _ in range(4)]
    rows = [(50, t) for t in several] + [(50, several[0])] + [(60 + k, edited(draw, t, 1)) for k, t in enumerate(several)]
    rows += [(3, edited(draw, several[2], 1)), (90, prose(draw, 120)), (91, prose(draw, 120)), (91, prose(draw, 120))]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 3, i == 3) for i in (3, 50, 60, 61, 62, 63)} | {(90, 90, True), (91, 91, True)}


def test_pruning_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(0)
    n = near_dedup.banding(85)[0] * near_dedup.banding(85)[1]
    a = draw.integers(0, 60_000, (20_000, n)).astype(np.uint16)
    for share, kept in ((0.85, 0.9999), (1.0, 1.0), (0.3, 0.0)):
        b = np.where(draw.random(a.shape) < share, a, a + 1).astype(np.uint16)
        rate = len(near_dedup.survivors(a, b, 85)) / len(a)
        assert rate >= kept if share > 0.5 else rate < 0.001


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 2), (2, 3), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(200, 260))}, 2: 2, 3: 2}


def plain_containment(docs, items, percent=80, width=5):
    """(document, item, its shingles, shared ones) by brute force over all pairs."""
    lists = lambda rows: [[w.lower() for w in (t or "").split()] for _, t in rows]
    cut = lambda ws, w: {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)}
    out = Counter()
    for (i, _), item in zip(items, lists(items), strict=True):
        w = min(width, len(item))
        for (d, _), doc in zip(docs, lists(docs), strict=True):
            own, theirs = cut(item, w) if w else set(), cut(doc, w) if w else set()
            if own and 100 * len(own & theirs) >= percent * len(own):
                out[d, i, len(own), len(own & theirs)] += 1
    return out


def test_items_in_documents_against_all_pairs(table):
    draw = random.Random(2)
    items = [(i, prose(draw, draw.choice([1, 2, 3, 4, 5, 14, 40, 300]))) for i in range(48)] + [(48, None), (49, ""), (None, "lone item of seven words in all"), (50, "lone item of seven words in all")]
    docs = [(i, prose(draw, draw.choice([1, 2, 4, 60, 3000]))) for i in range(60)]
    for i in range(60):
        text = items[draw.randrange(48)][1]
        docs.append((100 + i, docs[i][1] + " " + edited(draw, text, draw.choice([0, 1, 2])) + " " + prose(draw, 20)))
    docs += [(200, None), (201, ""), (None, items[3][1]), (202, "Lone item of seven words in ALL"), (202, "lone item of seven words in all")]
    want = plain_containment(docs, items)
    assert {len(items[i][1].split()) for _, i, *_ in want if i is not None} >= {1, 2, 3, 4}
    a, b = table(docs, "doc_id long, text string"), table(items, "item_id long, text string")
    assert Counter(map(tuple, decontaminate.contained_items(a, b).collect())) == want
    kept = decontaminate.decontaminated(a, b)
    held = set(plain_containment(list(enumerate(t for _, t in docs)), items))
    assert kept.columns == a.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d for k, d in enumerate(docs) if k not in {h[0] for h in held})
    assert decontaminate.contained_items(a.limit(0), b).collect() == [] == decontaminate.contained_items(a, b.limit(0)).collect()
    assert decontaminate.decontaminated(a, b.limit(0)).count() == len(docs)


def test_short_items_are_found_inside_long_documents(table):
    docs = [(0, "alpha beta gamma delta " + prose(random.Random(5), 9000)), (1, prose(random.Random(6), 9000) + " Beta"), (2, "gamma delta"), (3, "delta gamma beta alpha")]
    items = [(0, "alpha beta gamma delta"), (1, "beta"), (2, "gamma delta"), (3, "gamma delta epsilon")]
    got = {tuple(r) for r in decontaminate.contained_items(table(docs, "doc_id long, text string"), table(items, "item_id long, text string")).collect()}
    assert got == {(0, 0, 1, 1), (0, 1, 1, 1), (1, 1, 1, 1), (0, 2, 1, 1), (2, 2, 1, 1), (3, 1, 1, 1)}


def test_each_partition_has_its_own_sketch_and_threshold():
    draw = random.Random(4)
    index = decontaminate.Index([prose(draw, n) for n in (5, 6, 12, 40, 300, 2000)], 80, 5)
    parts = index.partitions[5]
    assert [p.sketch for p in parts] == [1, 2, 8, 32, 32, 32]
    assert len({p.needed for p in parts}) > 1 and [p.least for p in parts] == [1, 2, 7, 29, 237, 1597]
    for p, size in zip(parts, (1, 2, 8, 36, 296, 1996), strict=True):
        assert p.needed == decontaminate.needed_hits(size, p.sketch, 80)


def test_blocks_of_items_are_as_good_as_one(table, monkeypatch):
    draw = random.Random(3)
    items = [(i, prose(draw, 20)) for i in range(30)]
    docs = [(i, prose(draw, 50) + " " + items[i][1]) for i in range(30)]
    a, b = table(docs, "doc_id long, text string"), table(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contained_items(a, b).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert sorted(map(tuple, decontaminate.contained_items(a, b).collect())) == whole and len(whole) == 30


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls_against_a_plain_loop(spark, table):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("a.example.org/es/", "allow")]
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "x://EXAMPLE.org/es/a?b", "http://a.example.org/es/", "http://badexample.org/es/", "http://example.org/en/15#x", "http://example.org/en/2", "http://u.com/fr/", "http://com/de/x", "http://é.COM/de/", "http://a..com/fr/1", "http://x.net/", "http://a://b.org/", "http://example.org?x/es/", "http://h.org/" + "p" * 50_000, "http://example.org/es/\nnew", "http://example.org\n/es/"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, urls[6]), (6, urls[6]), (6, urls[6])]
    got = sorted(map(repr, map(tuple, url_filter.judge(table(pages, "page_id long, url string", ("host", "path", "rule", "verdict", "key", "id", "won")), url_filter.rule_table(spark, rules)).collect())))
    want = []
    for page, url in pages:
        host, path = plain_host_path(url)
        best = max(((len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=(0, None, "allow"))
        want.append((page, host, path, best[1], best[2]))
    assert got == sorted(map(repr, want))
    none = url_filter.judge(table(pages, "page_id long, url string"), url_filter.rule_table(spark, []))
    assert none.where("verdict <> 'allow' or rule is not null").count() == 0 and none.count() == len(pages)
    assert url_filter.judge(table([], "page_id long, url string"), url_filter.rule_table(spark, rules)).collect() == []


def test_licence_lines_and_wrapped_statements(table):
    docs = [(0, "Some prose here.\nReleased under the MIT License.\nMore."), (1, "released UNDER the mit license! Released under the MIT License."), (2, "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\nEnd."), (3, None), (4, ""), (5, "License"), (6, "Released under the BSD License or so they say."), (7, "word " * 50_000), (None, "Licensed under CC BY-NC 4.0."), (0, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.licence): (r.n_segments, r.dice) for r in licences.licence_scan(table(docs, "doc_id long, text string", ("licence", "n", "found", "model", "id"))).collect()}
    assert got[(0, "MIT")] == (1, 1.0) and got[(1, "MIT")] == (2, 1.0) and got[(None, "CC-BY-NC-4.0")] == (1, 1.0) and got[(0, "CC-BY-NC-4.0")][0] == 1
    assert got[(2, "GPL")][1] >= 0.8 and not {k[0] for k in got} & {3, 4, 5, 6, 7}
    assert licences.licence_scan(table([], "doc_id long, text string")).collect() == []


def test_long_lines_of_few_bigrams_match(table):
    padded = "Released under" + " -*- " * 6_000 + "the MIT License."
    repeated = " ".join(["Licensed under CC BY 4.0"] * 1_200)
    assert min(len(padded), len(repeated)) > 25_000
    got = {(r.doc_id, r.licence): (r.n_segments, r.dice) for r in licences.licence_scan(table([(0, padded), (1, repeated)], "doc_id long, text string")).collect()}
    assert got[(0, "MIT")] == (1, 1.0) and got[(1, "CC-BY-4.0")] == (1, 10 / 11)


def test_statements_inside_longer_sentences(table):
    docs = [(0, "Note that this program, Released under the MIT License, is provided to you, dear reader, as it stands."), (1, "The text (licensed under CC BY 4.0) and the pictures; all of them: nice."), (2, "We, released, under the, MIT, license."), (None, 'It says "Licensed under CC BY-NC 4.0" at the end'), (None, None), (3, "Licensed under the Apache License, Version 2.0.")]
    got = {(r.doc_id, r.licence): (r.n_segments, r.dice) for r in licences.licence_scan(table(docs, "doc_id long, text string", ("licence", "segment", "found", "words"))).collect()}
    assert got == {(0, "MIT"): (1, 1.0), (1, "CC-BY-4.0"): (1, 1.0), (2, "MIT"): (1, pytest.approx(got[(2, "MIT")][1])), (None, "CC-BY-NC-4.0"): (1, 1.0), (3, "Apache-2.0"): (1, 1.0)}


def plain_licences(docs):
    """{(document, licence): (matching units, best coefficient)} by brute force over all units and templates."""
    def pairs(text):
        ws = re.sub(r"[^\w]|_", " ", text.lower()).split()
        return set(zip(ws, ws[1:], strict=False))

    out = {}
    for doc, text in docs:
        for fine, coarse in ((re.split(r"\n|(?<=[.!?])[ \t\r]+", text or ""), [s for s in re.split(r"(?<=[.!?])\s+|\n\s*\n", text or "") if "\n" in s.strip()]),):
            for segment in fine + coarse:
                for unit in [segment, *(re.split(r"[,;:()\[\]\"]+", segment) if re.search(r"[,;:()\[\]\"]", segment) else [])]:
                    own = pairs(unit)
                    for licence, statement in licences.TEMPLATES:
                        model = pairs(statement)
                        if own and 200 * len(own & model) >= 80 * (len(own) + len(model)):
                            n, best = out.get((doc, licence), (0, 0.0))
                            out[doc, licence] = n + 1, max(best, 2 * len(own & model) / (len(own) + len(model)))
    return out


def test_licences_against_all_pairs(table):
    draw = random.Random(14)
    docs = []
    for i in range(150):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            words_ = draw.choice(licences.TEMPLATES)[1].split() if draw.random() < 0.6 else prose(draw, draw.choice([3, 20])).split()
            for _ in range(draw.choice([0, 0, 1, 4])):
                words_[draw.randrange(len(words_))] = draw.choice(WORDS)
            if draw.random() < 0.3:
                words_[draw.randrange(len(words_))] += "\n"
            parts.append(" ".join(words_) + draw.choice(["", ".", ", and so on.", ";"]))
        docs.append((i, draw.choice([" ", "\n", "\n\n", " (see) "]).join(parts)))
    docs += [(500, None), (501, ""), (502, "\nReleased under the MIT License."), (503, licences.TEMPLATES[4][1] + " - " * 9_000)]
    got = {(r.doc_id, r.licence): (r.n_segments, r.dice) for r in licences.licence_scan(table(docs, "doc_id long, text string")).collect()}
    assert got == plain_licences(docs) and len(got) > 60


def test_size_bounds_never_lose_a_match():
    for size in range(1, 60):
        least, most = licences.bounds(size, 80)
        for n in range(1, 120):
            if 200 * min(size, n) >= 80 * (size + n):
                assert least <= n <= most


def plain_maximal(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    gone = {c for c, v in lists.items() for d, u in lists.items() if c != d and u[: len(v)] == v and (len(u) > len(v) or d < c)}
    return {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v) for c, v in lists.items() if c not in gone}


def test_snapshots_collapse_to_the_longest(table):
    draw = random.Random(9)
    rows = []
    for conv in range(40):
        base = [("user" if k % 2 == 0 else "assistant", f"t{conv % 6}-{k}") for k in range(12)]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(base[: draw.randrange(1, 13)])]
    rows += [(90, k, "user", f"long{k}") for k in range(500)] + [(91, k, "user", f"long{k}") for k in range(499)]
    rows += [(98, None, "user", f"unnumbered {k % 90:03d} " + "x" * 80 + str(k)) for k in range(300)]
    rows += [(95, None, None, None), (95, 1, "a", "b"), (95, 1, "a", "b"), (96, 0, "ab", ""), (97, 0, "a", "b"), (None, 0, "user", "x")]
    draw.shuffle(rows)
    turns = table(rows, "conv_id long, turn long, role string, text string", ("k", "a", "b", "more", "conv", "segment"))
    parts = defaultdict(dict)
    for r in chat.rendered(turns, segment_turns=4).collect():
        assert r.n_turns <= 4
        parts[r.conv_id][r.segment] = r.chat
    want = plain_maximal(rows)
    assert {c: "".join(p[s] for s in sorted(p)) for c, p in parts.items()} == want
    whole = chat.rendered(turns, segment_turns=0).collect()
    assert {r.conv_id: r.chat for r in whole} == want and len(whole) == len(want)
    assert chat.rendered(turns.limit(0)).collect() == []


def test_totals_are_carried_over_many_partitions():
    values = [(c, chat.turn_digest("r", f"{c}-{k}")) for c, n in ((1, 3), (2, 11), (3, 1)) for k in range(n)]
    whole = {}
    for c, (a, _) in values:
        k, s = whole.get(c, (0, 0))
        whole[c] = (k + 1, (s + a * pow(chat.BASES[0], k + 1, 1 << 64)) & chat.MASK)
    for cuts in ([0, 2, 4, 5, 9, 15], [0, 15], [0, 1, 3, 14, 15]):
        edges = []
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            k, a, last = 0, 0, None
            for c, (x, _) in values[lo:hi]:
                k, a = (k, a) if c == last else (0, 0)
                k, a, last = k + 1, (a + x * pow(chat.BASES[0], k + 1, 1 << 64)) & chat.MASK, c
            edges.append((part, values[lo][0], last, k, a, 0))
        brought = chat.carries(edges)
        part, first, last, k, a, _ = edges[-1]
        start, n, x, _, more = brought[part]
        got = (k + n, (x + a * pow(chat.BASES[0], n, 1 << 64)) & chat.MASK) if start == last == first else (k, a)
        assert got == whole[3] and not more


def test_language_model_counts_and_base(odd_docs, table):
    draw = random.Random(1)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + [(i, " ".join(draw.choice(WORDS[:50]) for _ in range(30))) for i in range(100, 160)]
    tok = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))] + ["\0end"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.scores(table(rows, "doc_id long, text string")).collect())
    want = sorted((str(i), held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 5)) for i, t in rows)
    assert got == want
    assert lm.scores(table([], "doc_id long, text string")).collect() == []


def small_model():
    draw = np.random.default_rng(0)
    top = np.sort(draw.integers(0, 1 << 62, lm.TOP).astype(np.uint64))
    counts = lm.Counts(10_000, 1500, top, draw.integers(1, 50, lm.TOP), draw.integers(0, 30, lm.SHAPES).astype(float), draw.integers(0, 9, lm.SHAPES).astype(float))
    return counts, lm.Model.start(counts)


def test_class_probabilities_sum_to_one():
    _, model = small_model()
    size = lm.TOP + lm.SHAPES
    before = np.random.default_rng(1).integers(0, size + 1, (4, lm.CONTEXT))
    for row in before:
        every = lm.Scorer(model).log_probability(np.repeat(row[None], size, axis=0), np.arange(size))
        assert abs(np.exp(every).sum() - 1) < 1e-5


def test_training_learns_what_follows():
    counts, model = small_model()
    draw = np.random.default_rng(3)
    noise = counts.class_counts() + 0.5
    trainer = lm.Trainer(model, noise / noise.sum(), 0)
    before = draw.integers(0, 20, (40_000, lm.CONTEXT))
    target = (before[:, 0] + 1) % 20
    first = lm.Scorer(model).log_probability(before[:500], target[:500]).mean()
    for lo in range(0, 40_000, 1000):
        trainer.learn(before[lo : lo + 1000], target[lo : lo + 1000])
    assert lm.Scorer(trainer.model).log_probability(before[:500], target[:500]).mean() > first + 1.5


def test_runs_of_any_length_give_the_same_contexts(monkeypatch):
    counts, _ = small_model()
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 40, 30)
    row = {"codes": zstandard.compress(draw.integers(0, 300, lengths.sum()).astype("<u4").tobytes()), "vocabulary": np.append(counts.top[:150], draw.integers(0, 1 << 62, 150).astype(np.uint64)).tobytes()}
    row |= {"shapes": (np.arange(300) % lm.SHAPES).astype(np.uint8).tobytes(), "bounds": np.append(0, np.cumsum(lengths)).astype("<i8").tobytes(), "held": [False] * 30}
    whole = list(lm.Opened(row, counts).runs())
    assert len(whole) == 1
    doc, codes, tokens, before = whole[0]
    for k, (d, b) in enumerate(zip(doc, before, strict=True)):
        assert b.tolist() == [tokens[k - i - 1] if k - i - 1 >= 0 and doc[k - i - 1] == d else counts.size for i in range(lm.CONTEXT)]
    for run in (1, 2, 7, 100):
        monkeypatch.setattr(lm, "RUN", run)
        for a, b in zip(zip(*lm.Opened(row, counts).runs(), strict=True), whole[0], strict=True):
            assert (np.concatenate(a) == b).all()


def plain_log10(model, counts, c, text):
    """A text's score by one softmax loop over its tokens."""
    found = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))] + ["\0end"]
    total, last = 0.0, [counts.size] * lm.CONTEXT
    for word in found:
        raw = word.encode()
        name = lm.END if word == "\0end" else words.hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
        seat = np.flatnonzero(counts.top == name)
        shape = 0 if word == "\0end" else int(words.mix(np.array([raw[-1] | (raw[-2] << 8 if len(raw) > 1 else 0)], np.uint64))[0] % np.uint64(lm.SHAPES))
        own = int(seat[0]) if len(seat) else counts.size - lm.SHAPES + shape
        q = sum(model.inputs[x] * model.mixing[i] for i, x in enumerate(last))
        every = model.targets @ q + model.bias
        total += (every[own] - np.log(np.exp(every).sum())) / np.log(10)
        if not len(seat):
            total += log10((c[word] + 1) / (counts.shape_tokens[shape] + counts.shape_distinct[shape] + 1))
        last = [own, *last[:-1]]
    return total


@pytest.mark.parametrize(("top", "common"), [(40, 90), (3000, 1 << 18)])
def test_scores_are_those_of_a_plain_softmax_loop(table, monkeypatch, top, common):
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "COMMON", common)
    draw = random.Random(top)
    docs = [(i, " ".join(draw.choice(("The", "the", "cat", "SAT", *WORDS[: 5 * i])) for _ in range(draw.choice([0, 3, 40, 250])))) for i in range(1, 31)] + [(31, None), (32, ""), (None, "the cat sat")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in [*(t or "").lower().split(), "\0end"])
    chunks = lm.chunked(table(docs, "doc_id long, text string").repartition(8))
    counts, back = lm.corpus_counts(chunks, top)
    assert chunks.count() == 8 and (counts.tokens, counts.distinct) == (sum(c.values()), len(c))
    assert back.count() > 0 if common == 90 else back.count() == 0
    model = lm.train(chunks, counts)
    got = sorted((str(r.doc_id), r.score) for r in lm.scored(chunks, back, model, counts).collect())
    want = sorted((str(i), float(plain_log10(model, counts, c, t))) for i, t in docs)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-4)


def toxic_corpus(n=600, seed=0):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, bad = prose(draw, draw.choice([20, 80, 300])).split(), int(draw.random() < 0.3)
        if bad:
            at = draw.randrange(len(text))
            text[at:at] = [draw.choice(["grumbly", "Vileness.", "wretchful", "scornish"]) for _ in range(5)]
        docs.append((i, " ".join(text)))
        labels.append((i, 1, bad))
    return docs, labels


def test_toxic_documents_are_found_and_clean_ones_left(table):
    docs, labels = toxic_corpus()
    a, b = table(docs, "doc_id long, text string", ("score", "id", "passages")), table(labels + [(None, 1, 1), (3, 1, None), (99_999, None, 1)], "doc_id long, quality int, toxic int", ("id", "y"))
    model = toxicity.fit(a, b.where(~toxicity.held_out()))
    got = toxicity.score(a, model).withColumn("held", toxicity.held_out()).collect()
    truth, texts = {i: y for i, _, y in labels}, dict(docs)
    held = [r for r in got if r.held]
    assert held and sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.98
    for r in got:
        for p in r.passages:
            assert any(w in texts[r.doc_id].encode()[p.start : p.end].decode().lower() for w in ("grumbly", "vileness", "wretchful", "scornish"))


def test_rows_around_one_passage_all_count(table):
    draw = random.Random(12)
    passage = "every one of these pages carries this very sentence"
    docs = [(i, prose(draw, 20) + " " + passage + " " + prose(draw, 20)) for i in range(120)]
    docs += [(200, docs[0][1]), (201, docs[1][1].upper()), (202, docs[2][1]), (5, "another text of this id"), (5, docs[5][1]), (300, None), (301, "")]
    labels = [(i, 1, i % 2) for i, _ in docs if i != 202] + [(202, 1, 1)]
    got = [(r.id, r.y) for r in toxicity.training_rows(table(docs, "doc_id long, text string"), table(labels, "doc_id long, quality int, toxic int")).collect()]
    # 200 copies 0 with its label; 202 copies 2 with another one, 201 copies 1 but for letter case, with its label
    assert sorted(got) == [(i, i % 2) for i in range(120)] + [(202, 1), (300, 0), (301, 1)]
    few = toxicity.training_rows(table(docs, "doc_id long, text string"), table(labels, "doc_id long, quality int, toxic int"), rows=30)
    assert few.count() <= 30


def plain_evidence(model, text):
    """A text's evidence by plain loops: each token's most specific kept feature, then the recursive segments."""
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    found = re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", lowered)
    kept = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    named = lambda part, salt: int(words.mix((words.prefix_sums(np.frombuffer(part, np.uint8))[0][-1:] + np.uint64(salt)))[0])
    scores = []
    for word in found:
        options = [named(word[:k], k) for k in toxicity.PREFIXES if len(word) >= k] + [named(word, 1 << 32)]
        scores.append(next((kept[x] for x in reversed(options) if x in kept), 0.0))
    places = [i for i, x in enumerate(scores) if x]
    best = plain_segments(places, [scores[i] for i in places], model.drift) if places else []
    return model.evidence([(a, b, s) for a, b, s in best], len(found))


def test_toxicity_scores_against_plain_loops(table, odd_docs):
    docs, labels = toxic_corpus(200, seed=3)
    model = toxicity.fit(table(docs, "doc_id long, text string"), table(labels, "doc_id long, quality int, toxic int"))
    rows = [d for d in docs if len(d[1].split()) < 100][:40] + [(900, None), (901, ""), (902, "Grumbly, GRUMBLY; vileness!"), (None, "wretchful é ñ scornish")]
    got = sorted((str(r.doc_id), r.score) for r in toxicity.score(table(rows, "doc_id long, text string"), model).collect())
    want = sorted((str(i), float(model.probability(np.array([plain_evidence(model, t)]))[0])) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)
    kept = toxicity.accepted(table(rows, "doc_id long, text string"), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, x in want if x < toxicity.THRESHOLD)
    assert toxicity.accepted(odd_docs.limit(0), model).collect() == []


def test_toxicity_of_odd_documents_and_labels(odd_docs, table):
    docs, labels = toxic_corpus(200)
    model = toxicity.fit(table(docs, "doc_id long, text string"), table(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score < 0.7 for r in got)
    empty = toxicity.fit(table(docs, "doc_id long, text string"), table([], "doc_id long, quality int, toxic int"))
    assert {r.score < 0.01 for r in toxicity.score(odd_docs, empty).collect()} == {True}
    assert toxicity.score(odd_docs.limit(0), model).collect() == []


def plain_segments(places, scores, drift):
    """All maximal scoring subsequences by the recursive definition."""
    full = np.full(max(places, default=-1) + 1, -drift)
    full[list(places)] = scores

    def split(lo, hi):
        best, span = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += full[j]
                if total > best + 1e-12:
                    best, span = total, (i, j + 1)
        if span is None:
            return []
        return split(lo, span[0]) + [(*span, best)] + split(span[1], hi)

    return split(0, len(full))


def test_segments_against_the_recursive_definition():
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randrange(1, 25)
        places = sorted(draw.sample(range(n), draw.randrange(1, n + 1)))
        scores = [draw.choice([-3.7, -1.3, 0.6, 1.1, 2.9]) + draw.random() / 97 for _ in places]
        got = toxicity.maximal_segments(np.array(places), np.array(scores), 0.41)
        want = plain_segments(places, scores, 0.41)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_extreme_value_fit_recovers_its_parameters():
    draw = np.random.default_rng(5)
    n = draw.integers(50, 5000, 20_000)
    tops = (np.log(0.1 * n) - np.log(-np.log(draw.random(len(n))))) / 1.7
    decay, spread = toxicity.extreme_value(tops, n)
    assert abs(decay - 1.7) < 0.05 and abs(spread - 0.1) < 0.02


def test_pipeline_keeps_clean_documents(spark, tmp_path, table):
    import corpus_pipeline

    docs, labels = toxic_corpus(300, seed=6)
    draw = random.Random(8)
    item = prose(draw, 30)
    clean = [(1000 + i, prose(draw, 60)) for i in range(40)]
    docs = docs + clean + [(2000, clean[0][1]), (2001, edited(draw, clean[1][1] + " " + prose(draw, 200), 0)), (2002, prose(draw, 30) + " " + item), (2003, None), (2003, None), (None, "x y z")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, found, str(tmp_path))
        assert after.columns == found.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            wrong = sum((i in ids) == bool(y) for i, _, y in labels)
            assert wrong <= 6 and {1000 + k for k in range(40)} | {2000, 2002, 2003, None} <= ids
        if name == "near_dedup":
            assert 2000 not in ids and {1000, 2001, 2002, 2003, None} <= ids and after.where("doc_id = 2003").count() == 2
        if name == "decontamination":
            assert 2002 not in ids and 1000 in ids
        found = after
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def saved_corpus(folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark = docs.sparkSession
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def plain_pipeline(spark, rows, labels, items):
    """(id, text) rows that reach packing: scores by the operator, every other decision by brute force."""
    kind = "doc_id long, text string"
    model = toxicity.fit(spark.createDataFrame(rows, kind), spark.createDataFrame([r for r in labels if zlib.crc32(str(r[0]).encode()) % 3 != 1], "doc_id long, quality int, toxic int"))
    rows = [(i, t) for i, t in rows if model.probability(np.array([plain_evidence(model, t)]))[0] < toxicity.THRESHOLD]
    named = [(i, t) for i, t in rows if i is not None]
    groups = brute_groups(named, 80)
    rows = [(i, t) for i, t in rows if i is None or groups[i][1] == i]
    held = {k for k, *_ in plain_containment(list(enumerate(t for _, t in rows)), items)}
    return [r for k, r in enumerate(rows) if k not in held]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import store

    docs, labels = toxic_corpus(150, seed=16)
    docs = [(i, " ".join(t.split()[:90])) for i, t in docs]
    draw = random.Random(18)
    items = [(0, prose(draw, 15)), (1, "three word item"), (2, None)]
    docs += [(1000 + i, prose(draw, 50)) for i in range(30)]
    docs += [(2000 + i, edited(draw, docs[150 + i][1], i % 4)) for i in range(20)] + [(3000, docs[-1][1]), (3001, "before " + items[0][1]), (3002, "a three word item indeed"), (3003, None), (3004, ""), (None, docs[151][1])]
    clashing = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in docs], "doc_id long, text string, score string, id int, item string")
    saved_corpus(tmp_path, clashing, labels, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(spark, docs, labels, items)
    sizes = [(i, len(brute_word_ids(t))) for i, t in want]
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter(sizes) and 100 < len(want) < len(docs)
    assert sum(r.length for r in got) == sum(n for _, n in sizes)
    assert store.discard(spark) > 0 and store.discard(spark) == 0


def brute_word_ids(text):
    from tessera.llm import tokens

    return [*tokens.encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path, odd_docs):
    import corpus_pipeline

    saved_corpus(tmp_path / "odd", odd_docs, [(0, 1, 0)], [(None, None)])
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    # 1 equals 0, 6 equals 5 (both of its rows go), 8 is nearly 7; null ids, null and empty texts stay
    assert Counter(str(r.doc_id) for r in got if r.start == 0) == Counter(["0", "2", "3", "4", "5", "None", "None", "7", "9"])
    saved_corpus(tmp_path / "none", odd_docs.limit(0), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_drops_near_copies_just_above_four_fifths(spark):
    import corpus_pipeline

    rows = [(1, " ".join(WORDS[:100])), (2, " ".join(WORDS[:91] + WORDS[200:209])), (3, " ".join(WORDS[:88] + WORDS[300:312]))]
    first, *others = (set(s.tolist()) for s in words.shingle_sets(pa.array([t for _, t in rows], pa.string())))
    alike = [len(first & s) / len(first | s) for s in others]
    assert 0.8 < alike[0] < 0.85 and alike[1] < 0.8
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3}


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    from tessera.llm import store

    before = spark.conf.get(store.BATCH_SETTING, None)
    try:
        spark.conf.unset(store.BATCH_SETTING)
        store.bounded_batches(spark)
        assert spark.conf.get(store.BATCH_SETTING) == str(store.BATCH_BYTES)
        store.bounded_batches(spark, 1)
        assert spark.conf.get(store.BATCH_SETTING) == str(store.BATCH_BYTES)
        sizes = spark.range(0, 64, numPartitions=1).selectExpr("repeat('x', 1 << 20) t").mapInArrow(lambda bs: (b.select(["t"]).slice(0, 1) for b in bs), "t string")
        assert sizes.count() >= 8  # one row a batch: a batch holds a few rows of a megabyte
    finally:
        spark.conf.unset(store.BATCH_SETTING) if before is None else spark.conf.set(store.BATCH_SETTING, before)
