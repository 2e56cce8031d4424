"""The text operators against brute force, exact round trips and awkward inputs."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, chat_format, decontamination, license_scan, minhash_dedup, pii, quality_classifier
from factloom.llm import quality_rules, substring_dedup, toxicity
from factloom.llm.text import shingle_hashes

AWKWARD = [None, "", " \n\t", "one", "two words", "Ü " * 20000, "x" * 30000, "a b c d e f", "A B c D e f", "a b c d e f"]


def documents(spark, texts=AWKWARD):
    rows = [(i, t, "en", None, 0, "clash", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean"
    )


def clear_text(seed: int, n: int = 120) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(3, 8))) for _ in range(n))


def test_shingles_lower_case_ascii_only_and_short_texts_are_one():
    assert len(shingle_hashes(b"a b c d", 3)) == 2
    assert list(shingle_hashes(b"A  b\nC d", 3)) == list(shingle_hashes(b"a b c d", 3))
    assert len(shingle_hashes(b"a b", 3)) == 1 and len(shingle_hashes(b" \n", 3)) == 0
    assert list(shingle_hashes("Ä b c".encode(), 3)) != list(shingle_hashes("ä b c".encode(), 3))


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(5)
    texts = list(AWKWARD)
    for seed in range(12):
        words = clear_text(seed).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = "changed%d" % draw.randrange(10**6)
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDE", "abcde")))
        sets.append(set(zip(w, w[1:], w[2:])) if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    left = minhash_dedup.without_copies(documents(spark, texts), 3, 85)
    assert left.columns == documents(spark).columns
    assert {r.doc_id for r in left.collect()} == set(root)


def test_bpe_equals_the_tokenizers_library():
    tokenizers = pytest.importorskip("tokenizers")
    known = bpe.vocabulary(bpe.default_vocabulary())
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    draw = random.Random(2)
    texts = ["", " ", "don't 'sad !!'s <|endoftext|>Hello<|startoftext|>", "ΑΣ İstanbul é 日本語 😀👍🏽", "ha" * 40, "\x1ca\x85b"]
    texts += ["".join(draw.choice("abcdeghinorst'éü日😀 <|>\n1") for _ in range(60)) for _ in range(500)]
    for text, (ids, names), want in zip(texts, known.encode_texts(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == " ".join(map(str, want.ids)), text
        assert names == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_on_awkward_rows(spark):
    rows = bpe.bpe(documents(spark), ["doc_id", "row", "kept"]).collect()
    assert [len(r.ids) for r in rows[:3]] == [0, 0, 0] and rows[0].decoded == "" and rows[1].row.row == "clash"


def test_leaks_and_licences(spark):
    item = clear_text(1, 20)
    texts = [*AWKWARD, clear_text(2) + " " + item.upper() + " " + clear_text(3), clear_text(4), "x. Released under\nthe MIT License! y"]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    found = decontamination.leaks(documents(spark, texts), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(len(AWKWARD), 1), (4, 4)}
    left = decontamination.clean(documents(spark, texts), items)
    assert left.count() == len(texts) - 2 and left.columns == documents(spark).columns
    licences = license_scan.license_matches(documents(spark, texts), license_scan.templates(spark)).collect()
    assert [(r.doc_id, r.license, r.first_word) for r in licences] == [(len(texts) - 1, "MIT", 1)]
    assert decontamination.leaks(documents(spark, []), items).count() == 0


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _base_spans(text: str) -> list[str]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_spans_and_disclosing_terms(spark):
    hard = [
        *AWKWARD, "a@b.c-d@e.f a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.01 12.3.4",
        "4111 1111 1111 1111 +1 (555) 123-4567 890. é😀 +1-4111-1111-1111-1111 10.0.0.1 " * 3, "1" * 3000 + " 2" * 2000,
    ]
    plain = len(hard)
    hard += [f"{clear_text(i, 30)} zanzibar writes from boss@corp.example now" for i in range(4)]
    hard += [clear_text(i, 30) for i in range(100, 500)] + ["zanzibar at home"]
    rows = sorted(pii.personal_data(documents(spark, hard)).collect(), key=lambda r: r.doc_id)
    for r in rows:
        base = _base_spans(hard[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == base
    assert [r.n_term for r in rows[plain : plain + 4]] >= [1] * 4 and rows[-1].n_term == 1
    clean = {r.doc_id: r for r in pii.sanitised(documents(spark, hard)).collect()}
    assert clean[len(hard) - 1].text == "[TERM] at home" and clean[0].text is None and clean[1].row == "clash"
    assert "@" not in clean[plain].text and clean[plain].n_chars == len(clean[plain].text)


def test_terms_of_values_in_one_text_short_hyphenated_and_of_hot_values(spark):
    filler = [clear_text(i, 60) for i in range(1000, 1300)]
    copies = [f"{clear_text(1, 60)} {'waldo'} {clear_text(2, 60)} far@corp.example {clear_text(3, 60)}"] * 5
    hot = [f"{clear_text(i, 30)} Gateway 10.0.0.9 {clear_text(i + 50, 30)}" for i in range(2000, 2040)]
    texts = [
        *filler, *copies, *hot, f"{filler[0]} Jo-Ann Wu ann@corp.example {filler[1]}",
        f"{filler[2]} Ötz +1 (555) 123-4567 {filler[3]}", "GATEWAY of x", "ÖTZ",
    ]
    rows = {r.doc_id: r for r in pii.personal_data(documents(spark, texts)).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(documents(spark, texts)).collect()}
    n = len(filler) + len(copies) + len(hot)
    named = clean[n]
    assert "Jo-Ann" not in named and "Wu" not in named.split() and "[EMAIL]" in named
    assert all("waldo" in clean[i] for i in range(len(filler), len(filler) + 5))
    assert "Gateway" not in clean[n - 1] and clean[n + 2] == "[TERM] of x" and rows[n + 2].spans == "term:0:7"
    assert "Ötz" in clean[n + 1] and rows[n + 3].spans == ""  # held by one text beside the value and one without it


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "a\\", " </turn>\n### user: x", "", "####", "\\###", "x\\</turn>", "é😀: </turn>\n", None]
    roles = ["user", "assistant", "a: b", "r\\", "### x\n", None]
    data = [(c, t, roles[(c + t) % 6], nasty[(c * 5 + t) % 9]) for c in range(30) for t in range(7)] + [(None, None, None, None)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    back = defaultdict(list)
    for r in chat_format.format_chats(frame).orderBy("conv_id", "piece").collect():
        back[r.conv_id] += chat_format.parse(r.formatted)
    want = defaultdict(list)
    for c, _, role, text in data:
        want[c].append((role or "", text or ""))
    assert back == want
    for r in chat_format.digests(chat_format.format_chats(frame)).collect():
        trained = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest() and r.loss_chars == len(trained)


def _removed(texts):
    counts, out = Counter(), []
    data = [(t or "").encode() for t in texts]
    for b in data:
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("crowd", [5000, 3])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "MAX_CONTEXTS", crowd)
    draw = random.Random(3)
    base = ["".join(draw.choice("ab c\0é") for _ in range(700)) for _ in range(4)]
    texts = [
        None, "", "short", base[0], base[0][:300] + "X" + base[0][301:], base[1] + base[2], "q" * 700,
        base[2][100:500] + base[3], "ab" * 300 + base[3][10:260], base[3][:199], base[3][5:] + base[3][:350], "y" * 199, "y" * 199,
    ] + [f"u{i} " * 3 + base[1][50:400] + clear_text(i, 30) for i in range(12)]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(documents(spark, texts)).collect()}
    for i, (n, kept) in enumerate(_removed(texts)):
        assert (sum(s.stop - s.start for s in got[i].spans), bytes(got[i].kept)) == (n, kept), i


def test_merged_orders_equal_for_any_shard_size():
    draw = random.Random(9)
    parts = [bytes(draw.choice(b"ab\0") for _ in range(60)) * 4 for _ in range(8)]
    strings = [p + q for p in parts for q in parts[:3]]
    want = substring_dedup.repeated_runs(strings)
    for shard in (200, 1000, 10**9):
        start, classes = substring_dedup.merged_classes(strings, shard)
        assert [classes[s] for s in start] == [substring_dedup.merged_classes(strings)[1][s] for s in start]
    counts = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    for s, runs in zip(strings, want):
        often = {i for a, b in runs for i in range(a, b + 1)}
        assert often == {i for i in range(len(s) - 199) if counts[s[i : i + 200]] > 1}


def test_groups_of_a_crowded_anchor_are_bounded_in_bytes(spark, monkeypatch):
    """Pairs of near copies under one shared header: all their windows would meet in a few groups."""
    block, sizes, merge = 20_000, [], substring_dedup.merged_spans

    def spy(contexts):
        contexts = contexts.persist()
        sizes.append(contexts.groupBy("g").agg(F.sum(F.length("data")).alias("n")).agg(F.max("n")).first()[0])
        return merge(contexts)

    monkeypatch.setattr(substring_dedup, "merged_spans", spy)
    monkeypatch.setattr(substring_dedup, "MAX_CONTEXTS", 20)
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    header = clear_text(7, 20)[:110] + " "
    texts = []
    for i in range(150):
        body = clear_text(1000 + i, 45)[:200]
        texts += [header + body + " x", header + body + " y"]
    rows = substring_dedup.without_repeats(documents(spark, texts).select("doc_id", "text")).collect()
    assert all(len(r.kept) == 1 for r in rows)
    assert 0 < max(sizes) <= 2 * block


def test_quality_rules(spark):
    texts = [*AWKWARD, clear_text(1), "spam ham " * 200, "line a b\nline a b\n\n\n" + clear_text(2)]
    rows = {r.row.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts), ["doc_id"]).collect()}
    n = len(AWKWARD)
    assert rows[n].kept and not rows[n + 1].kept and rows[n + 1].base_failed and rows[n + 2].n_dup_lines == 1
    assert rows[0].base_failed and rows[0].n_words == 0
    assert quality_rules.repeated_words("a b c x a b c d a b c".split()) == 9
    assert quality_rules.passing(documents(spark, texts)).columns == documents(spark).columns


def test_quality_limits_come_from_the_corpus(spark):
    draw = random.Random(4)

    def base64_words(n):
        raw = base64.b64encode(draw.randbytes(n)).decode()[:n]
        return " ".join(raw[i : i + 9] for i in range(0, n, 9))

    def printable(n):
        return "".join(" " if draw.random() < 0.15 else chr(draw.randint(33, 126)) for _ in range(n))

    clean = [clear_text(i, int(60 * 30 ** draw.random())) for i in range(1000)]
    sizes = (700, 2000, 4000, 10000, 15000)
    junk = [base64_words(n) for n in sizes] + [printable(n) for n in (700, 2600, 8000)]
    junk += [" ".join(f"{w} same" for w in clear_text(i, n).split()) for i, n in ((1, 200), (2, 900))]
    junk += [clear_text(5, n) + " " + base64_words(m) for n, m in ((70, 500), (340, 900), (1050, 1000))]
    rows = {r.row.doc_id: r for r in quality_rules.quality_rules(documents(spark, clean + junk), ["doc_id"]).collect()}
    assert [i for i in range(len(clean)) if not rows[i].kept] == []
    assert [i for i in range(len(junk)) if rows[len(clean) + i].kept] == []
    assert not any(rows[len(clean) + i].base_failed for i in range(len(junk)))
    for n in (0, 1, 200, 256, 257, 3000, 4095, 4096, 6143, 6144, 9000):
        parts = quality_rules.chunks(bytes(n))
        assert n <= sum(map(len, parts)) < n + quality_rules.CHUNK and max(map(len, parts)) <= quality_rules.CHUNK


@pytest.mark.parametrize("percent", [2, 8, 20, 40])
def test_quality_limits_hold_whatever_the_share_of_junk(spark, percent):
    draw = random.Random(percent)
    clean = [clear_text(i, int(60 * 30 ** draw.random())) for i in range(500)]
    junk = []
    for text in clean[: 5 * percent]:
        raw = base64.b64encode(draw.randbytes(len(text))).decode()[: max(500, len(text))]
        junk.append(" ".join(raw[i : i + 8] for i in range(0, len(raw), 8)))
    rows = {r.row.doc_id: r for r in quality_rules.quality_rules(documents(spark, clean + junk), ["doc_id"]).collect()}
    assert sorted(i for i in rows if rows[i].kept) == list(range(len(clean)))
    assert not any(r.base_failed for r in rows.values())


def test_quality_limits_of_a_few_documents_reject_junk_too(spark):
    junk = [base64.b64encode(random.Random(i).randbytes(900)).decode() for i in range(3)]
    texts = [clear_text(1), clear_text(2, 400), *[" ".join(t[i : i + 8] for i in range(0, len(t), 8)) for t in junk]]
    rows = quality_rules.quality_rules(documents(spark, texts), ["doc_id"]).collect()
    assert [r.kept for r in sorted(rows, key=lambda r: r.row.doc_id)] == [True, True, False, False, False]
    assert quality_rules.quality_rules(documents(spark, []), ["doc_id"]).count() == 0


def test_quality_counts_equal_brute_force(spark):
    draw = random.Random(9)
    texts = list(AWKWARD)
    for _ in range(150):
        words = [draw.choice(["a", "bb", "ccc", "d#d", "é", "日本", "x|y", "A"]) for _ in range(draw.randint(0, 25))]
        texts.append("".join(w + draw.choice([" ", "  ", "\n", "\n\n", "\t"]) for w in words))
    got = {r.row.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts), ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeated = sum(x in lines[:k] for k, x in enumerate(lines))
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_toxicity_and_quality_learn_and_survive_missing_labels(spark):
    texts = [*AWKWARD, *[clear_text(i, 40) + (" vile scum here" if i % 4 == 0 else "") for i in range(200)]]
    docs = documents(spark, texts)
    marks = [(i, int("scum" in (t or ""))) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([m for m in marks if m[0] % 3] + [(5, None)], "doc_id long, y int")
    scores = {r.row.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    held = [(i, y) for i, y in marks if i % 3 == 0 and i >= len(AWKWARD)]
    assert all((scores[i] >= toxicity.THRESHOLD) == bool(y) for i, y in held) and len(scores) == len(texts)
    none = labels.filter("y = 0")
    assert toxicity.toxicity(docs, toxicity.fit(docs, none), ["doc_id"]).filter("score >= 0.3").count() == 0
    evidence = quality_classifier.document_evidence(docs, quality_classifier.fit(docs, none), ["doc_id", "source", "lang"])
    scored = quality_classifier.with_site_priors(
        evidence.select("row.doc_id", F.col("row.source").alias("host"), F.col("row.lang").alias("path"), "p")
    )
    assert scored.count() == len(texts) and scored.filter("score is null").count() == 0


def test_pipeline_runs_over_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    texts = [*AWKWARD, *[clear_text(i) for i in range(5)], clear_text(1), clear_text(7, 10) + " " + clear_text(8)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, clear_text(7, 10))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    n = len(AWKWARD)
    assert sorted(r.doc_id for r in rows) == [n, n + 1, n + 2, n + 3, n + 4]
