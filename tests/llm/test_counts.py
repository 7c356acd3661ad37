"""Source divergence, tokenizer alignment and token counts against brute force."""

import hashlib
import random
import re
import sys
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from scanmill.llm import alignment, divergence, token_counts
from scanmill.llm.oracles import ORACLES
from scanmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n long, radix int, place int, term string, pair long"
ODD = [
    None, "", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", " \n\n  a", "՘x", "\U0001f600 hi", "it's I'LL",
    "</s> <s> <unk> ", "▁ under", "\x00\x01 null", "日本語テキスト", "  two  blanks ", "　wide\x85\x1c", "é ﬁ ½", "�", "tab\tend\n",
    "\U000e0100", "Ａ full",
]


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3, "t", 4) for r in rows], DOCS)


def odd_texts(rng, n):
    pools = [lambda: rng.randrange(32, 127), lambda: rng.randrange(1, 0x3000), lambda: rng.randrange(1, 0xD800), lambda: 32, lambda: 10, lambda: rng.randrange(0x1F000, 0x1FA00)]
    return ["".join(chr(rng.choice(pools)()) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


# token counts


def test_every_settled_character_is_in_the_same_class_for_the_library():
    pieces = regex.compile(public_tokenizers.PATTERN)
    of_library = Tokenizer.from_file(A).pre_tokenizer.pre_tokenize_str
    letters = sorted(token_counts._settled())
    assert len(letters) > 140_000 and not any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in letters[::97])
    for at in range(0, len(letters), 4096):
        text = "".join(f"a{c}1{c}!{c}" for c in letters[at : at + 4096])
        assert [end for _, (_, end) in of_library(text)] == [m.end() for m in pieces.finditer(text)]


def test_token_counts_and_ids_equal_the_library():
    own, library, plain = token_counts.WholeTokens(A), Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    texts = [t or "" for t in ODD] + odd_texts(random.Random(3), 3000) + ["ab" * 30_000, "word " * 30_000]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.ids(t) for t in texts] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_stand_alone_and_blocks_change_nothing(monkeypatch):
    own, library = token_counts.WholeTokens(A), Tokenizer.from_file(A)
    some = sorted(own.whole)[::50]
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some) and len(own.whole) > 45_000
    text = " ".join(odd_texts(random.Random(4), 400))
    assert "".join(token_counts.blocks(text, 50)) == text and len(list(token_counts.blocks(text, 50))) > 20
    assert [p for part in token_counts.blocks(text, 50) for p in own.pieces(part)] == own.pieces(text)


def test_token_counts_of_rows(spark):
    rows = [(i if i % 5 else None, t, "en", "s") for i, t in enumerate(ODD)] + [(1, "", "en", "s"), (7, "w " * 1025, "en", "s"), (8, "w" + " w" * 1023, "en", "s")]
    library = Tokenizer.from_file(A)
    want = sorted((str(d), len((t or "").encode()), n, n > 1024) for d, t, *_ in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    got = token_counts.token_counts(frame(spark, rows).repartition(3), A)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.token_counts(frame(spark, []), A).count() == 0


def test_token_counts_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    library = Tokenizer.from_file(A)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op13_token_counts"](spark, SF).collect()} == want


# alignment


def brute_alignment(texts):
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {letter: b for b, letter in enumerate(token_counts.byte_letters())}
    names = {i: v for v, i in plain.get_vocab().items()}
    all_links, shapes = [], []
    for text in texts:
        a = plain.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_bytes = [names[i].encode() if i == 50256 else bytes(letters[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != b" " + text.encode() or b"".join(b_bytes) != b" " + text.encode():
            all_links.append([])
            shapes.append((0, 0, 0, ""))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        found, j = [], 0
        for i, x in enumerate(a):
            start = a_ends[i] - len(a_bytes[i])
            while b_ends[j] <= start:
                j += 1
            k = j
            while k < len(b) and b_ends[k] - len(b_bytes[k]) < a_ends[i]:
                found.append((x, b[k]))
                k += 1
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            to_a, to_b = list(a_ends).index(end) + 1, list(b_ends).index(end) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        all_links.append(found)
        shapes.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for found in all_links for p in set(found))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (*s[:3], len(f), sum(counts[p] == best[p[0]] for p in f), sum(counts[p] for p in f), s[3]) for f, s in zip(all_links, shapes, strict=True)
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, monkeypatch, small):
    if small:  # many runs and several merges for each radix
        monkeypatch.setattr(alignment, "RUN_LINKS", 300)
        monkeypatch.setattr(alignment, "GROUP_RECORDS", 20)
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    texts = ODD + odd_texts(random.Random(5), 60) + given + given[:5] + ["the same words"] * 30
    rows = [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(texts)]
    got = alignment.aligned(frame(spark, rows).repartition(5), A, B)
    assert got.columns == ["doc_id", *NAMES]
    want = sorted((str(d), *w) for (d, *_), w in zip(rows, brute_alignment(texts), strict=True))
    assert sorted((str(r.doc_id), *(r[n] for n in NAMES)) for r in got.collect()) == want


def test_alignment_query_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(docs, brute_alignment([r.text for r in docs]), strict=True)}
    got = QUERIES["op12_tokenizer_alignment"](spark, SF).collect()
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in got} == want
    assert alignment.aligned(frame(spark, []), A, B).count() == 0
    spelled = alignment.aligned(frame(spark, [(1, "tokenizers", "en", "s"), (2, None, "en", "s")]), A, B, spelled=True).collect()
    assert {r.doc_id: hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in spelled} == {r.doc_id: r.groups_sha256 for r in spelled}


# divergence


def brute_divergence(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(counts[g])

        def share(of, t):
            return 1 + 10**9 * (of[t] + 2) // (sum(of[k] for k in kept) + 2 * len(kept))

        pairs = []
        for other in groups:
            if other[0] == lang and other != (lang, source):
                both = [(share(counts[lang, source], t), share(counts[other], t)) for t in kept]
                pairs.append((-sum((p - q) ** 2 // (p + q) for p, q in both), other[1].encode()))
        terms = []
        for t in kept:
            p, q = share(counts[lang, source], t), share(total, t)
            if counts[lang, source][t] and p > q:
                terms.append((-((p - q) ** 2 // (p + q)), t.encode()))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of terms and of groups
        monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
        monkeypatch.setattr(divergence, "BLOCK_GROUPS", 5)
    rng = random.Random(11)
    terms = ["the", "Of", "été", "ÉTÉ", "日本", "x_y", "don't", "\U0001f600", *(f"w{'abcdefgh'[k % 8]}{'xyz' * (k % 5)}" for k in range(60))]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice([f"s{k}" for k in range(14)] + [None, "ü"])
        of = terms[hash(source) % 20 :] if rng.random() < 0.7 else terms
        rows.append((i if i % 9 else None, rng.choice([None, "", *[" ".join(rng.choices(of, k=rng.randrange(1, 30)))] * 9]), lang, source))
    rows += [(1, "few terms", "xx", "a"), (2, None, "xx", "b"), (3, "", "alone", "c"), *rows[:20]]
    got = divergence.divergence(frame(spark, rows).repartition(4))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence([(t, g, s) for _, t, g, s in rows], 10)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_divergence_query_equals_its_twin(spark):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duckdb.execute(ORACLES["op11_source_divergence"]).fetchall())
    assert sorted(map(tuple, QUERIES["op11_source_divergence"](spark, SF).collect())) == want


def test_quadtree_prices_every_cell():
    rng = np.random.default_rng(2)
    for n, width, some in ((1, 1, 1), (3, 700, 5), (70, 300, 400), (40, 17, 600), (5, 9, 0)):
        at = rng.choice(n * width, min(some, n * width), replace=False)
        base = rng.integers(1, 1000, n)
        full = np.repeat(base[:, None], width, axis=1)
        values = rng.integers(1, 10**9, len(at))
        full[at // width, at % width] = values
        sums = divergence.pair_sums(divergence.Quadtree(at // width, at % width, values, base), width)
        for a in range(n):
            for b in range(a + 1, n):
                assert sums[a, b] == divergence.price(full[a], full[b]).sum()
    assert sys.maxsize > (10**9 + 1) ** 2
