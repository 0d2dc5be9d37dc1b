import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import token_alignment as A
from tessera.llm.queries import tokenizer_file
from tests.llm.conftest import make_docs
from tests.llm.test_cut_encoder import PARTS

A_PATH, B_PATH = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    from tessera.llm.cut_encoder import bytes_of_characters
    own = bytes_of_characters()
    spell_a = lambda i: bytes(own[c] for c in t.id_to_token(i))
    spell_b = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("\u2581", " ").encode()
    rows, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
            bytes_a, bytes_b = [spell_a(i) for i in a], [spell_b(i) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = set(np.cumsum([len(x) for x in bytes_a]).tolist()) & set(np.cumsum([len(x) for x in bytes_b]).tolist())
                sides = defaultdict(lambda: ([], []))
                for side, (ids, spelt) in enumerate(((a, bytes_a), (b, bytes_b))):
                    at = g = 0
                    for i, x in zip(ids, spelt, strict=True):
                        sides[g][side].append(i)
                        at += len(x)
                        g += at in ends
                groups = [sides[g] for g in sorted(sides)]
        links = Counter()
        for a, b in groups:
            for x in a:
                for y, n in Counter(b).items():
                    links[x, y] += n
        held.update(links.keys())
        rows.append((groups, links))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for groups, links in rows:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for (a, b), n in links.items() if held[a, b] == top[a]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def result(docs):
    out, pairs = A.alignment(docs, A_PATH, B_PATH)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs


def fuzz():
    rnd = random.Random(4)
    rows = [(r[0], r[1]) for r in make_docs()]
    rows += [(1000 + k, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40)))) for k in range(300)]
    return rows + [(2000, "a" * 5000), (2001, "b" + "a" * 3001), (2002, " "), (2003, "-" * 777 + "=" * 778), (2004, "\U0001f600" * 50), (2005, "0" * 999)]


def test_matches_plain_version(spark):
    rows = fuzz()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, pairs = result(docs)
    want = plain([t for _, t in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=repr)
    assert pairs.agg({"n_links": "sum"}).first()[0] == sum(w[3] for w in want)


def test_groups_by_distinct_ids_give_the_same_links(monkeypatch):
    import pyarrow as pa

    from tessera.llm.cut_encoder import ByteLevelEncoder, PieceEncoder
    from tessera.llm.words import utf8
    own = ByteLevelEncoder(A_PATH, specials=False), PieceEncoder(B_PATH)
    found = A.aligned(*utf8(pa.array([t for _, t in fuzz()])), own, tuple(np.array([len(t) for t in e.token_bytes()]) for e in own))
    counts = []
    for listed in (0, 1 << 40):
        monkeypatch.setattr(A, "LISTED", listed)
        total = Counter()
        for *link, n in zip(*(x.tolist() for x in found.links()), strict=True):
            total[tuple(link)] += n
        counts.append(total)
    assert counts[0] == counts[1]


def test_clashing_columns_and_empty_table(spark, odd, rows):
    got, _ = result(odd)
    want = plain([r[1] for r in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)
    assert result(odd.limit(0))[0].count() == 0


def test_bitmaps_round_trip():
    rng = np.random.default_rng(2)
    members = [np.sort(rng.choice(A.DOCS, n, replace=False)) for n in (1, 2, A.SPARSE - 1, A.SPARSE, 3000, A.DOCS)]
    key = np.repeat(np.arange(len(members)), [len(m) for m in members])
    first, n, bitmaps = A.sets(key, np.concatenate(members))
    assert n.tolist() == [len(m) for m in members] and key[first].tolist() == list(range(len(members)))
    assert all(len(b) == min(2 * len(m), A.DOCS // 8) for b, m in zip(bitmaps.to_pylist(), members, strict=True))
    row, position = A.positions(bitmaps)
    assert [np.sort(position[row == k]).tolist() for k in range(len(members))] == [m.tolist() for m in members]


def test_containers_or_chunks_and_count_with_planes():
    held = A.Container()
    rng = np.random.default_rng(3)
    want = Counter()
    for _ in range(6):
        a, b, doc, n = rng.integers(0, 5, 4000), rng.integers(0, 3, 4000), rng.integers(0, 600, 4000), rng.integers(1, 40, 4000)
        held.add(a, b, doc, n)
        for x in zip(a.tolist(), b.tolist(), doc.tolist(), n.tolist(), strict=True):
            want[x[:3]] += x[3]
    columns, rows = held.postings(9)
    got = Counter()
    for k in range(rows):
        a, b, n_docs, n_links = (int(columns[c][k].as_py()) for c in (1, 2, 3, 4))
        _, docs = A.positions(columns[5].slice(k, 1))
        assert len(docs) == n_docs
        for d in docs.tolist():
            got[a, b, d] += 1
        for digit in range(len(columns[6][k])):
            for d in A.positions(columns[6].slice(k, 1).flatten().slice(digit, 1))[1].tolist():
                got[a, b, d] += 1 << digit
        assert n_links == sum(v for (x, y, _), v in want.items() if (x, y) == (a, b))
    assert got == want
