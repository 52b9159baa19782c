"""The registered queries without SQL, and the pipeline stage by stage, against brute force on a table with planted rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("cuetrace.llm")
import corpus_pipeline  # noqa: E402
from cuetrace.llm import decontaminate, queries, secret_scan  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile("[^\x20\x09-\x0D!-/:-@\\[-`{-~]+")
FIRST = 10_000  # planted doc_ids
CLEAN = "The harbour office keeps its own tide tables, and clerk number {} copies them out by hand each spring morning."


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("planted")
    documents, benchmark, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    some = [t for t in documents["text"] if t and 150 < len(WORD.findall(t)) < 400][:4]
    near = some[1].split(" ")
    near[len(near) // 2] = "exchanged"
    passage = " ".join(some[2].split(" ")[:60])
    item = max(benchmark["text"].dropna(), key=len)
    changed = PLAIN_WORD.findall(item)[:13]
    changed[3], changed[9] = "other", "words"
    line = "All lines of this kind are longer than forty characters."
    planted = [some[0], some[0], some[1], " ".join(near), f"{CLEAN.format(1)} {passage} {CLEAN.format(2)}",
               f"{CLEAN.format(3)}\n{passage}", f"{CLEAN.format(4)} {item} {CLEAN.format(5)}",
               f"{CLEAN.format(6)} {' '.join(changed)} {CLEAN.format(7)}", None, "", " \t\n", "Yes.",
               "a <|endoftext|> b　c<|endoftext|>", 'api_key = "abcdef123" AKIA' + "Q" * 16 + " " + "f" * 24 + "é",
               *[f"{CLEAN.format(10 + i)}\n  {line}\t\n{line.upper()}\nown {i}" for i in range(6)]]
    extra = pd.DataFrame({"doc_id": range(FIRST, FIRST + len(planted)), "text": planted, "lang": "en", "source": "web",
                          "n_chars": [len(t or "") for t in planted]})
    pd.concat([documents, extra], ignore_index=True).to_parquet(out / "documents.parquet")
    benchmark.to_parquet(out / "benchmark.parquet")
    labels.to_parquet(out / "labels.parquet")
    return str(out)


@pytest.fixture(scope="module")
def texts(folder):
    read = pd.read_parquet(f"{folder}/documents.parquet")
    return dict(sorted(zip(read["doc_id"].tolist(), read["text"].where(read["text"].notna(), None).tolist())))


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def answer(spark, folder, name):
    return queries.build()[name](spark, folder).collect()


def check_pieces(rows, texts, ids_of):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = ids[r["start"]:r["start"] + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return len(sequences), -(-sum(r["length"] for r in rows) // 1024)


def test_packing(spark, folder, texts, ids_of):
    used, least = check_pieces(answer(spark, folder, "op3_packing"), texts, ids_of)
    assert used <= least + 2


def test_passages(spark, folder, texts):
    seen, expected = set(), {}
    for doc_id, text in texts.items():
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        expected[doc_id] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in answer(spark, folder, "op4_passages")}
    assert found == expected and expected[FIRST + 5][1] >= 59


def near_duplicates(texts):
    """n_shingles, component and number of links of each document."""
    sets = {}
    for doc_id, text in texts.items():
        w = WORD.findall(lower(text))
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label, links = {d: d for d in sets}, dict.fromkeys(sets, 0)
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for a, b in edges:
        links[a], links[b] = links[a] + 1, links[b] + 1
        low, high = sorted((label[a], label[b]))
        label = {d: low if k == high else k for d, k in label.items()}
    return {d: (len(sets[d]), label[d], links[d]) for d in sets}


def test_jaccard(spark, folder, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in answer(spark, folder, "op5_jaccard")}
    expected = near_duplicates(texts)
    assert found == expected and expected[FIRST + 1][1] < FIRST and expected[FIRST + 3][1] < FIRST


def test_wavelet(spark, folder, texts, ids_of):
    at, expected = 0, {}
    for doc_id, text in texts.items():
        ids = ids_of(text)
        expected[doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in answer(spark, folder, "op6_wavelet")}
    assert found == expected


def test_secrets(spark, folder, texts):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    plain = [("assign", assign, 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    found = {r["doc_id"]: r for r in answer(spark, folder, "op7_secrets")}
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        base = sorted((m.start(), k, m.end()) for k, (_, regex, group, least) in enumerate(plain)
                      for m in regex.finditer(text or "") if len(m[group]) >= least)
        r, n = found[doc_id], [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n
        written = [f"{plain[k][0]}:{begin}:{end}" for begin, k, end in base]
        assert r["base_sha256"] == sha(",".join(written))
        everything = sorted((m.start(), k, m.end()) for k, rule in enumerate(secret_scan.RULES)
                            for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.min_chars)
        assert r["spans"] == ",".join(f"{secret_scan.RULES[k].name}:{begin}:{end}" for begin, k, end in everything)
        assert set(written) <= set(r["spans"].split(","))
    assert found[FIRST + 13]["n_assign"] == found[FIRST + 13]["n_access"] == found[FIRST + 13]["n_hex"] == 1


def overlaps(texts, folder):
    """Pairs (doc_id, item_id) with an alignment in which a window's words differ in few places."""
    number = defaultdict(lambda: len(number))
    items = pd.read_parquet(f"{folder}/benchmark.parquet")
    docs = {d: np.array([number[w] for w in PLAIN_WORD.findall(lower(t))]) for d, t in texts.items()}
    found = set()
    for item_id, text in zip(items["item_id"].tolist(), items["text"].tolist()):
        item = np.array([number[w] for w in PLAIN_WORD.findall(lower(text))])
        size = min(len(item), decontaminate.WINDOW)
        if size < decontaminate.LEAST_WORDS:
            continue
        wrong = decontaminate.SUBSTITUTIONS * size // decontaminate.WINDOW
        for doc_id, doc in docs.items():
            n = len(doc) - size + 1
            if n <= 0:
                continue
            same = {j: doc == w for j, w in enumerate(item)}
            if any((sum(same[j + k][k:k + n].astype(np.int8) for k in range(size)) >= size - wrong).any()
                   for j in range(len(item) - size + 1)):
                found.add((doc_id, item_id))
    return found


def test_decontaminate(spark, folder, texts):
    found = {(r["doc_id"], r["item_id"]) for r in answer(spark, folder, "op9_decontaminate")}
    assert found == overlaps(texts, folder)
    assert {FIRST + 6, FIRST + 7} <= {d for d, _ in found}


def without_lines(texts):
    """The texts without keys of at least 40 code points in at least 5 documents, but in the last of them."""
    def key(line):
        return lower(line.strip("\x20\x09\x0A\x0B\x0C\x0D"))

    held = defaultdict(set)
    for doc_id, text in texts.items():
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    drop = {k: max(ids) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    return {d: "\n".join(x for x in (t or "").split("\n") if drop.get(key(x), d) == d) for d, t in texts.items()}


def test_pipeline_by_stage(spark, folder, texts, ids_of, monkeypatch):
    given = {}

    def watched(name, stage):
        def run(spark_, docs, sf_dir):
            given[name] = docs.collect()
            return stage(spark_, docs, sf_dir)
        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f)) for n, f in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, folder).collect()
    inputs = {name: {r["doc_id"]: r["text"] for r in rows} for name, rows in given.items()}
    assert all(len(inputs[name]) == len(rows) for name, rows in given.items())
    quality, lines, pairs, leaks, packing = (inputs[name] for name, _ in corpus_pipeline.STAGES)
    assert quality == texts
    assert all(texts[d] == t for d, t in lines.items()) and len(lines) >= 0.7 * len(texts)
    assert pairs == without_lines(lines)
    component = near_duplicates(pairs)
    assert leaks == {d: t for d, t in pairs.items() if component[d][1] == d}
    marked = {d for d, _ in overlaps(leaks, folder)}
    assert packing == {d: t for d, t in leaks.items() if d not in marked}
    check_pieces(packed, packing, ids_of)
    assert all(r["n_chars"] == len(r["text"] or "") for r in given["packing"] if r["doc_id"] >= FIRST)
