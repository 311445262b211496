"""Pieces of the operators against brute force or the library they follow."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tessera.llm import byte_bpe, embedding_dups, simhash, token_counts
from tessera.llm.hnsw import Graph
from tessera.llm.ngrams import PASS_CHARS, Ngrams


def test_ngrams_count_words_and_windows():
    g = Ngrams(chars=(3, 4), words=1)
    for text in ["", " ", "a", "hello  world\nfoo", "x" * 50 + " y"]:
        want = sum(1 + sum(max(0, len(w) + 3 - n) for n in (3, 4)) for w in text.split())
        assert len(g.of(text)) == want


def test_ngrams_do_not_depend_on_passes():
    random.seed(0)
    texts = ["".join(random.choice("ab é\n") for _ in range(n)) for n in (0, 1, 40, 900)] + ["word é " * (PASS_CHARS // 4)]
    g = Ngrams(chars=(2, 3), words=2)
    found = {}
    for who, what in g.passes(texts):
        for a, b in zip(who.tolist(), what.tolist()):
            found.setdefault(a, []).append(b)
    for i, t in enumerate(texts[:-1]):
        assert sorted(found.get(i, [])) == sorted(g.of(t).tolist())
    # nothing is lost at a seam: words, and pairs of words
    one = texts[-1]
    n = len(one.split())
    assert len(g.of(one)) == n + (n - 1) + n // 2 * (len(Ngrams(chars=(2, 3), words=0).of("word é")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=120), max_size=6), st.integers(1, 3))
def test_ngrams_are_alike_however_short_the_passes(texts, words):
    from tessera.llm import ngrams
    g, kept = Ngrams(chars=(1, 2, 3), words=words), ngrams.PASS_CHARS
    want = [sorted(g.of(t).tolist()) for t in texts]
    try:
        ngrams.PASS_CHARS = 7
        found = {}
        for who, what in g.passes(texts):
            for a, b in zip(who.tolist(), what.tolist()):
                found.setdefault(a, []).append(b)
    finally:
        ngrams.PASS_CHARS = kept
    assert [sorted(found.get(i, [])) for i in range(len(texts))] == want


M = 1 << 32


def _naive_buckets(g, text):
    """The n-grams of a text one by one, hashed in plain integers."""
    def bucket(h, salt):
        h = (h ^ (salt * 0x85EBCA6B % M)) * 0x9E3779B1 % M
        h ^= h >> 15
        return (h * 0x2C1B3C6D % M) >> (32 - g.bits)

    out, hashes = [], []
    for w in text.lower().split():
        s = f" {w} "
        for size in g.chars:
            for i in range(len(s) - size + 1):
                part = s[i:i + size]
                if part.strip() and (size > 1 or part != " "):
                    h = 0
                    for c in part:
                        h = (h * 0x01000193 + ord(c)) % M
                    out.append(bucket(h, size))
        hashes.append(sum(ord(c) * pow(0x01000193, i, M) for i, c in enumerate(w)) % M)
    for k in range(1, g.words + 1):
        for i in range(len(hashes) - k + 1):
            h = hashes[i]
            for x in hashes[i + 1:i + k]:
                h = (h * 0x27D4EB2F + x) % M
            out.append(bucket(h, 100 + k))
    if g.words > 1:
        out += [bucket(0, 100) for a, b in zip(hashes, hashes[1:]) if a == b]
    return out


TEXTS = ["", "a", "one two two three", "Ünï cödé İ x", "the quick brown fox " * 30, "!!! ??? 12 12 12"]


@pytest.mark.parametrize("g", [Ngrams(chars=(2, 3, 4), words=2), Ngrams(chars=(3, 4, 5), words=1), Ngrams(chars=(1, 2, 3), words=0, bits=16)])
def test_ngrams_against_plain_integers(g):
    for t in TEXTS:
        assert sorted(g.of(t).tolist()) == sorted(_naive_buckets(g, t))


def test_scores_against_a_dictionary():
    from tessera.llm.langid import LanguageModel
    from tessera.llm.subword_model import SubwordModel
    rng = np.random.default_rng(3)
    g = Ngrams(chars=(2, 3), words=2, bits=12)
    kept = rng.random(g.buckets) < 0.5
    model = SubwordModel(g, np.where(kept, rng.normal(size=g.buckets), 0).astype(np.float32), kept, -0.3)
    for t, got in zip(TEXTS, model.scores(TEXTS)):
        used = [b for b in _naive_buckets(g, t) if kept[b]]
        odds = sum(float(model.weight[b]) for b in used) / max(len(used), 1) - 0.3
        assert abs(got - 1 / (1 + np.exp(-odds))) < 1e-6
    c = Ngrams(chars=(1, 2), words=0, bits=10)
    lang = LanguageModel(c, ["a", "b", "c"], rng.normal(size=(3, c.buckets)).astype(np.float32), rng.normal(size=3), 0.7)
    for t, (name, p) in zip(TEXTS, lang.predict(TEXTS)):
        if not any(ch.isalpha() for ch in t):
            assert (name, p) == ("und", 0.0)
            continue
        used = _naive_buckets(c, t)
        z = [(sum(float(lang.weight[j][b]) for b in used) / len(used) + lang.bias[j]) / 0.7 for j in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert name == "abc"[int(e.argmax())] and abs(p - e.max() / e.sum()) < 1e-6


def test_gradients_of_the_subword_model_by_differences():
    from tessera.llm.subword_model import gradients
    rng = np.random.default_rng(4)
    E, W, b = rng.normal(size=(9, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    flat, doc, y, cost = np.array([0, 4, 4, 7, 8, 1]), np.array([0, 0, 1, 1, 1, 3]), np.array([1, 0, 1, 0]), np.array([0.7, 1.6])
    part = np.array([0.5, 0.5, 0.25, 0.25, 0.5, 1.0])

    def loss():
        total = 0
        for d in range(4):
            h = sum((part[i] * E[flat[i]] for i in range(6) if doc[i] == d), np.zeros(3))
            z = h @ W + b
            total += cost[y[d]] * (np.log(np.exp(z).sum()) - z[y[d]]) / 4
        return total

    dW, db, at, dE = gradients(E, W, b, flat, part, doc, y, cost)
    full = np.zeros_like(E)
    full[at] = dE
    for array, grad in ((W, dW), (b, db), (E, full)):
        for i in np.ndindex(array.shape):
            array[i] += 1e-6
            up = loss()
            array[i] -= 2e-6
            assert abs((up - loss()) / 2e-6 - grad[i]) < 1e-6
            array[i] += 1e-6


def test_ftrl_against_single_coordinates():
    from tessera.llm import langid
    s = langid.Settings(epochs=2, batch=2, alpha=0.3, l1=0.2, l2=0.01)
    ids, tf, y = [np.array([0, 2]), np.array([1]), np.array([2, 3]), np.array([0, 1, 3]), np.array([4])], [np.array([1.0, 2.0]), np.array([3.0]), np.array([0.5, 1.5]), np.ones(3), np.array([2.0])], np.array([0, 1, 2, 0, 1])
    W, b = langid._ftrl(ids, tf, y, 3, 5, s, np.random.default_rng(1))
    z, n, rng = {}, {}, np.random.default_rng(1)

    def weight(j, i):
        v, l1 = z.get((j, i), 0.0), 0 if i == 5 else s.l1
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((s.beta + n.get((j, i), 0.0) ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        order = rng.permutation(5)
        for lo in range(0, 5, 2):
            g, w = {}, {}
            for r in order[lo:lo + 2]:
                x = dict(zip(ids[r].tolist(), tf[r].tolist())) | {5: 1.0}
                logit = np.array([sum(v * weight(j, i) for i, v in x.items()) for j in range(3)])
                p = np.exp(logit - logit.max())
                p /= p.sum()
                for j in range(3):
                    for i, v in x.items():
                        g[j, i] = g.get((j, i), 0.0) + (p[j] - (y[r] == j)) * v
                        w[j, i] = weight(j, i)
            for at, d in g.items():
                old = n.get(at, 0.0)
                z[at] = z.get(at, 0.0) + d - ((old + d * d) ** 0.5 - old ** 0.5) / s.alpha * w[at]
                n[at] = old + d * d
    for j in range(3):
        assert np.allclose([weight(j, i) for i in range(6)], [*W[j], b[j]])


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    return byte_bpe.load(path, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_byte_bpe_follows_the_library(tik, text):
    ours, library = tik
    ids = ours.encode(text)
    assert ids == library.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_byte_bpe_special_strings_and_long_words(tik):
    ours, library = tik
    for text in ["<|endoftext|> <unk> <s>", "x" * 30000, " " * 5000, "a\x1cb\x85c\xa0d", "日本語 👍🏽 \U0003f636抡", "1" * 999 + "é" * 999]:
        assert ours.encode(text) == library.encode_ordinary(text)


def test_byte_bpe_forgets_and_relearns(tik, monkeypatch):
    ours, library = tik
    monkeypatch.setattr(byte_bpe, "MEMORY", 20)
    monkeypatch.setattr(byte_bpe, "GROUP_CHARS", 50)
    random.seed(3)
    texts = ["".join(random.choice("abcdeé ") for _ in range(60)) for _ in range(60)]
    assert list(ours.encode_all(texts)) == [library.encode_ordinary(t) for t in texts]


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.load(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_token_counts_follow_the_library(words, text):
    ours, library = words
    assert next(ours.counts([text])) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_token_counts_special_strings_repeats_and_memory(words, monkeypatch):
    ours, library = words
    monkeypatch.setattr(token_counts, "MEMORY", 20)
    monkeypatch.setattr(token_counts, "GROUP_CHARS", 50)
    random.seed(4)
    texts = ["", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "a" * 501, "ab" * 400, "İ ẞ ΑΣ é don't I'LL", "!!!???!!!"]
    texts += ["".join(random.choice("abcdeÉ' 12") for _ in range(60)) for _ in range(60)]
    got = [n for _, n in ours.counts(texts)]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def _slow_links(fps, radius):
    return {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius}


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(radius + 3)] + [np.array([0, 2**64 - 1], np.uint64)])
    found = {(int(i), int(j)) for a, b in simhash.links_within(fps, radius, rows=50) for i, j in zip(a, b)}
    assert found == _slow_links(fps, radius)


def test_fingerprint_matches_the_definition(monkeypatch):
    import xxhash
    random.seed(5)
    monkeypatch.setattr(simhash, "PIECE", 64)
    for n in (0, 1, 3, 4, 5, 300, 700):
        words = ["".join(random.choice("abCÉ") for _ in range(random.randint(1, 5))) for _ in range(n)]
        text = " \t".join(words) + "\n"
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        shingles = [" ".join(low[i:i + 4]) for i in range(n - 3)] if n >= 4 else [" ".join(low)] if n else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_blocks_cover_every_pair_inside_the_radius():
    rng = np.random.default_rng(0)
    for blocks in (5, 6, 7):
        masks = simhash._masks(4, blocks)
        for _ in range(300):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(diff & m == 0 for m in masks)


def test_graph_finds_links_in_tight_groups():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x = np.concatenate((x, x[0] + 0.05 * rng.normal(size=(400, 32)), x[1:200] + 0.02 * rng.normal(size=(199, 32))))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[rng.permutation(len(x))]
    graph = Graph.build(x.astype(np.float32))
    truth = {(i, j) for i, j in np.argwhere(x @ x.T >= 0.9).tolist()}
    found = set()
    for r, i in graph.within(x.astype(np.float32), 0.9 - 1e-5, 48):
        found |= {(int(a), int(b)) for a, b in zip(r, i)}
    assert len(found & truth) >= 0.99 * len(truth)
    for n in (0, 1, 2, 9):
        small = Graph.build(x[:n].astype(np.float32))
        if n:
            assert sum(len(r) for r, _ in small.within(x[:n].astype(np.float32), 0.999, 4)) >= n


def _blind_graph(n=600, d=32):
    """Unit vectors whose last half are near copies of the first, in a graph
    where no link leads to a copy."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d))
    x = np.concatenate((x, x + 0.02 * rng.normal(size=x.shape)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph.build(x.astype(np.float32))
    for links in graph.links:
        links[links >= n] = -1
    graph.levels[n:] = 0
    graph.entry = int(graph.levels.argmax())
    return graph, x


def test_op1_audit_judges_a_shard_without_copies_and_marks_what_is_cut_off():
    graph, x = _blind_graph()
    lost = ~embedding_dups._reached(graph)
    assert lost[600:].all() and lost[:600].sum() < 6
    width, recall = embedding_dups._audited(graph, x, lost, 0.9, 48, 0.99, 256)
    assert recall >= 0.99 and width < len(x)
    got = {(int(a), int(b)) for r, i, _ in embedding_dups._links(graph, x, x, lost, 0.9, width) for a, b in zip(r, i)}
    true = {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.9)}
    assert got <= true and len(got) >= 0.99 * len(true)
    # without the marks, half of the members are out of reach of any beam: the audit says so
    wide, recall = embedding_dups._audited(graph, x, np.zeros(len(x), bool), 0.9, 48, 0.99, 256)
    assert wide >= len(x) and recall < 0.9
    # a shard in which nothing links: the audit passes on turned members
    plain = Graph.build(x[:600].astype(np.float32))
    width, recall = embedding_dups._audited(plain, x[:600], np.zeros(600, bool), 0.9, 48, 0.99, 256)
    assert recall >= 0.99 and width < 600


def test_op1_dense_groups_are_compared_exactly():
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.normal(size=(1, 16)) + 0.03 * rng.normal(size=(200, 16)), rng.normal(size=(300, 16))))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph.build(x.astype(np.float32))
    lost = ~embedding_dups._reached(graph)
    parts = list(embedding_dups._links(graph, x, x, lost, 0.9, 48))
    assert sum(dense for _, _, dense in parts) >= 200
    got = [(int(a), int(b)) for r, i, _ in parts for a, b in zip(r, i)]
    assert len(got) == len(set(got)) and set(got) == {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.9)}
