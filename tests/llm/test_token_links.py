"""Aligned tokenizers against plain computation with the libraries themselves."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm.queries import LLM_QUERIES, vocabulary_path
from plumbline.llm.token_links import DENSE, ENTRIES, inverted_pairs, opened, pair_scores, planes_of, token_links

FOLDER = "/root/testdata/sf0.001"
A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


def _plain(rows):
    """The contract by dictionaries: one row per (id, text)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    first, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    a_bytes = {i: bytes(letter[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items() if t != "<|endoftext|>"}
    b_bytes = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, range(model.get_piece_size()))]
    docs, counts = [], collections.Counter()
    for key, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            if b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                at, ends_a, ends_b = 0, {}, {}
                for side, size, ends in ((a, a_bytes, ends_a), (b, b_bytes, ends_b)):
                    at = 0
                    for n, i in enumerate(side):
                        at += len(size[i])
                        ends[at] = n
                low_a = low_b = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    links.append((a[ends_a[end]], b[ends_b[end]]))
                    groups.append(",".join(map(str, a[low_a : ends_a[end] + 1])) + "|" + ",".join(map(str, b[low_b : ends_b[end] + 1])))
                    low_a, low_b = ends_a[end] + 1, ends_b[end] + 1
        counts.update(links)
        docs.append((key, n_a, n_b, links, groups))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(key, n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for key, n_a, n_b, links, groups in docs], counts


def test_op12_equals_plain_computation(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op12_token_links"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(_plain(given)[0])


def test_token_links_defined_cases(spark):
    texts = [None, "", " ", "plain words", "plain words", "two  spaces\n\nand\ttabs", "<s> and <|endoftext|> </s> <unk>", "▁ is no space", "日本語 🙂 é", "ﬁ ligature", "x" * 5000, "word " * 210_000]
    rows = [(None if n == 4 else f"rvl-{n}", t) for n, t in enumerate(texts)] + [("rvl-3", "plain words")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "entry_id string, exact_text string, n_links int").repartition(3)
    want, counts = _plain(rows)
    assert sorted(map(tuple, token_links(frame, A, B).collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] == 0 for r in want) >= 3
    scores = pair_scores(inverted_pairs(frame, A, B)).collect()
    assert {(r.a, r.b): r.n_links for r in scores} == dict(counts)
    assert max(r.n_entries for r in scores) <= len(rows)
    assert token_links(spark.createDataFrame([], "entry_id long, exact_text string"), A, B).count() == 0


def test_planes_round_trip():
    rng = random.Random(2)
    for entries, pairs in ((50, 7), (ENTRIES, 3)):
        rows = {(rng.randrange(pairs), rng.randrange(entries)): rng.choice([1, 1, 2, 3, 70]) for _ in range(3 * entries)}
        rows |= {(pairs, n): 5 for n in range(min(entries, DENSE + 3))}
        keys, counts = zip(*rows.items(), strict=True)
        found, planes = planes_of(np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.uint16), np.array(counts))
        assert found.tolist() == sorted({k[0] for k in keys})
        back = collections.Counter()
        for part, first in ((planes.slice(0, 2), 0), (planes.slice(2), 2)):
            part = pa.concat_arrays([part]) if first == 0 else part
            for row, bit, entry in zip(*(x.tolist() for x in opened(part)), strict=True):
                back[int(found[row + first]), entry] += 1 << bit
        assert dict(back) == rows
