"""Vocabulary, encoding, packing, masking against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.constants import CLS_ID, IGNORE_LABEL, MASK_ID, SEP_ID, SPECIAL_TOKENS
from corpuslens.operators import masking, packing, tokens, vocabulary

TEXT = (
    "the thin thinker thought the thing there then; banana bandana bananas aaa aaaa abab ababab "
    "low lower lowest newer newest wider widest the the then other mother brother bother !!! !!"
)


def brute_force_vocabulary(counts, size):
    words = {w: [w[0]] + ["##" + c for c in w[1:]] for w in counts}
    letters = Counter({form + c: 0 for w in counts for c in w for form in ("", "##")})
    for w, n in counts.items():
        for s in words[w]:
            letters[s] += n
    vocab = SPECIAL_TOKENS + [s for s, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
    while len(vocab) < size:
        pairs = Counter()
        for w, n in counts.items():
            for a, b in zip(words[w], words[w][1:]):
                pairs[a, b] += n
        best = min(pairs.items(), key=lambda p: (-p[1], p[0]), default=None)
        if best is None:
            break
        (a, b), _ = best
        token = vocabulary.merged(a, b)
        for w, symbols in words.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == [a, b]:
                    out.append(token)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            words[w] = out
        if token not in vocab:
            vocab.append(token)
    return vocab


def trained(counts, size, look_ahead, monkeypatch, candidates=1 << 15):
    monkeypatch.setattr(vocabulary, "CANDIDATES", candidates)
    return vocabulary.train_vocabulary(counts, size, look_ahead)


def test_vocabulary_equals_one_merge_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(TEXT,), ("the thing and the other thing",)], "text string")
    counts = vocabulary.word_counts(df)
    known = {r["word"]: r["n"] for r in counts.collect()}
    for size, look_ahead, candidates in ((500, 1000, 99999), (66, 40, 99999), (66, 0, 99999), (80, 90, 20)):
        assert trained(counts, size, look_ahead, monkeypatch, candidates) == brute_force_vocabulary(known, size)
    with pytest.raises(ValueError, match="letters"):
        vocabulary.train_vocabulary(counts, 30)


def test_look_ahead_equals_one_merge_at_a_time():
    """Rounds of every reach, on words whose merges collide in many ways."""
    rng = random.Random(3)
    for trial in range(60):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))): rng.choice([1, 1, 2, 3, 50]) for _ in range(25)}
        expected = brute_force_vocabulary(counts, 60)
        vocab = expected[: 5 + 2 * len(set("".join(counts)))]
        ids = {t: i for i, t in enumerate(vocab)}
        words = [[ids[c if k == 0 else "##" + c] for k, c in enumerate(w)] for w in counts]
        weights = list(counts.values())
        while len(vocab) < 60:
            pairs = Counter()
            for w, n in zip(words, weights):
                for p in zip(w, w[1:]):
                    pairs[p] += n
            ranked = [(*p, n) for p, n in sorted(pairs.items(), key=lambda x: (-x[1], vocab[x[0][0]], vocab[x[0][1]]))]
            if not ranked:
                break
            reach = rng.randint(1, len(ranked))
            covered = {r[:2] for r in ranked[:reach]}
            seen = [(list(w), n) for w, n in zip(words, weights) if covered & set(zip(w, w[1:]))]
            merges = vocabulary.leading_merges(
                [w for w, _ in seen], [n for _, n in seen], ranked[:reach], ranked[reach] if reach < len(ranked) else None, vocab, 60
            )
            assert merges
            for a, b, z in merges:
                words = [vocabulary.merge_pair(w, a, b, z) for w in words]
        assert vocab == expected, trial


def test_last_round_of_training_rewrites_no_word(spark, monkeypatch):
    counts = vocabulary.word_counts(spark.createDataFrame([(TEXT,)], "text string"))
    known = {r["word"]: r["n"] for r in counts.collect()}
    monkeypatch.setattr(vocabulary, "_merge_words", lambda *_: pytest.fail("the vocabulary is full"))
    assert vocabulary.train_vocabulary(counts, 66) == brute_force_vocabulary(known, 66)


def test_look_ahead_reads_arrow_lists():
    import pyarrow as pa

    vocab = [*SPECIAL_TOKENS, "a", "##b", "##c"]
    words = pa.array([[0], [5, 6, 7], [5, 6], [6, 7, 6, 7]], pa.list_(pa.int32())).slice(1)
    merges = vocabulary.leading_merges(words, pa.array([3, 1, 2]), [(6, 7, 7), (5, 6, 4)], None, vocab, 99)
    # ##b ##c seven times, then a ##bc three times, then ##bc ##bc twice, then a ##b once.
    assert merges == [(6, 7, 8), (5, 8, 9), (8, 8, 10), (5, 6, 11)]
    assert vocab[8:] == ["##bc", "abc", "##bcbc", "ab"]


def test_encoding_equals_library(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece

    df = spark.createDataFrame(
        [(0, TEXT + " unknownzzz thé"), (1, ""), (2, None), (3, "then Banana?")], "id int, text string"
    )
    vocab = vocabulary.train_vocabulary(vocabulary.word_counts(df.where("id <> 0")), 40)
    vocab += ["th", "##in", "the", "ban", "##ana", "##a", "b", "##b", "a"]
    vocab = list(dict.fromkeys(vocab))
    library = Tokenizer(WordPiece({t: i for i, t in enumerate(vocab)}, unk_token="[UNK]"))
    rows = tokens.encode(df.withColumn("w", tokens.pre_tokens(F.col("text"))), vocab).collect()
    for r in rows:
        want_ids, want_words = [], []
        for place, word in enumerate(r["w"] or []):
            ids = library.encode(word).ids
            want_ids += ids
            want_words += [place] * len(ids)
        assert (r["ids"] or []) == want_ids
        assert (r["word_ids"] or []) == want_words


def test_wrapped_rows(spark):
    df = spark.createDataFrame([("a b c d e f",)], "text string")
    vocab = SPECIAL_TOKENS + list("abcdef")
    row = tokens.token_rows(df, vocab, max_len=6).first()
    assert row["input_ids"] == [CLS_ID, 5, 6, 7, 8, SEP_ID]
    assert row["special_tokens_mask"] == [1, 0, 0, 0, 0, 1]
    assert row["word_ids"] == [None, 0, 1, 2, 3, None]
    a, b = F.array(F.lit(7)), F.array(F.lit(8), F.lit(9))
    pair = spark.range(1).select(
        tokens.wrap_special(a, b).alias("ids"), tokens.segment_ids(a, b).alias("segments")
    ).first()
    assert pair["ids"] == [1, 7, 2, 8, 9, 2]
    assert pair["segments"] == [0, 0, 0, 1, 1, 1]


def brute_force_pack(rows, size, keep_short):
    flat = [t for row in rows for t in row]
    total = len(flat)
    if total >= size or not keep_short:
        total = total // size * size
    return [flat[i : i + size] for i in range(0, total, size)]


@pytest.mark.parametrize("keep_short", [False, True])
@pytest.mark.parametrize("size", [1, 4, 7])
def test_pack(spark, size, keep_short):
    batches = {
        0: [[1, 2, 3], [], [4, 5, 6, 7, 8, 9, 10, 11, 12], [13]],
        1: [[1], [2]],
        2: [[], []],
        3: [[5] * 4, [6] * 3, [7]],
    }
    data = [("g", b, i, row) for b, rows in batches.items() for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, batch bigint, row_no bigint, input_ids array<int>")
    got = packing.pack(df, ["g"], size, keep_short).orderBy("batch", "chunk").collect()
    for b, rows in batches.items():
        mine = [r["input_ids"] for r in got if r["batch"] == b]
        assert mine == brute_force_pack(rows, size, keep_short)


def test_masking(spark):
    ids = [CLS_ID] + list(range(5, 500)) * 40 + [SEP_ID]
    df = spark.createDataFrame([("c1", ids)], "key string, input_ids array<int>")
    masked = masking.mlm_mask(df, F.col("key"), 500, seed=42).first()
    picked = [i for i, x in enumerate(masked["labels"]) if x != IGNORE_LABEL]
    assert 0.14 < len(picked) / len(ids) < 0.16
    assert 0 not in picked and len(ids) - 1 not in picked
    assert all(masked["labels"][i] == ids[i] for i in picked)
    hidden = sum(masked["masked_ids"][i] == MASK_ID for i in picked) / len(picked)
    kept = sum(masked["masked_ids"][i] == ids[i] for i in picked) / len(picked)
    assert 0.77 < hidden < 0.83 and 0.08 < kept < 0.13
    untouched = set(range(len(ids))) - set(picked)
    assert all(masked["masked_ids"][i] == ids[i] for i in untouched)
    other = masking.mlm_mask(df, F.col("key"), 500, seed=42, epoch=1).first()
    assert other["labels"] != masked["labels"]
    labels = spark.range(1).select(masking.clm_labels(F.array(F.lit(7), F.lit(3)), 3).alias("l")).first()["l"]
    assert labels == [7, IGNORE_LABEL]


def test_long_words_and_padding(spark):
    vocab = {"a": 5, "##a": 6, "##aaa": 7}
    assert tokens.longest_match("a" * 400_000, vocab, 5) == [5] + [7] * 133_333
    assert tokens.longest_match("ab", vocab, 5) == [0]
    ids = packing.pad(F.array(F.lit(7), F.lit(8)), 4)
    assert spark.range(1).select(ids.alias("x")).first()["x"] == [7, 8, 3, 3]
    assert spark.range(1).select(packing.pad(F.array(F.lit(7), F.lit(8)), 2).alias("x")).first()["x"] == [7, 8]


def test_frequent_pieces_lose_nothing(spark):
    """Every word of known letters is spelled by its pieces; the rules of the vocabulary by hand."""
    long_word = "ab" * 40
    df = spark.createDataFrame([(TEXT + " " + long_word,), (None,), ("",)], "text string")
    counts = vocabulary.word_counts(df)
    known = {r["word"]: r["n"] for r in counts.collect()}
    vocab = vocabulary.frequent_pieces(counts, 150, endings=20)
    letters = {c for w in known for c in w}
    alphabet = sorted(letters | {"##" + c for c in letters})
    endings = Counter("##" + w[k:] for w in known for k in range(max(1, len(w) - 31), len(w) - 1))
    best = [p for p, _ in sorted(endings.items(), key=lambda x: (-x[1], x[0]))[:20]]
    whole = [w for w, _ in sorted(known.items(), key=lambda x: (-x[1], x[0])) if 2 <= len(w) <= 32]
    assert vocab == list(dict.fromkeys(SPECIAL_TOKENS + alphabet + best + whole))[:150]
    new = spark.createDataFrame([(0, "thinthen eht " + long_word + " otherbanana !;!"), (1, "tabqé")], "id int, text string")
    for r in tokens.encode(new.withColumn("w", tokens.pre_tokens(F.col("text"))), vocab).collect():
        spelled = ["" for _ in r["w"]]
        for i, place in zip(r["ids"], r["word_ids"]):
            spelled[place] += vocab[i].removeprefix("##") if spelled[place] else vocab[i]
        assert spelled == r["w"] if r["id"] == 0 else spelled == ["[UNK]"]
    with pytest.raises(ValueError, match="letters"):
        vocabulary.frequent_pieces(counts, 40)


def test_a_task_matches_a_word_once(monkeypatch):
    import pyarrow as pa

    asked, plain = [], tokens.longest_match
    monkeypatch.setattr(tokens, "longest_match", lambda w, *rest: asked.append(w) or plain(w, *rest))
    vocab = {"a": 5, "##b": 6, "ab": 7}
    rows = pa.array([["ab", "abb", "ab"], None, ["x"]], pa.list_(pa.string()))
    matched = tokens.Matched(vocab)
    first, again = (tokens.match_batch(rows, matched).to_pylist() for _ in range(2))
    assert first == again == tokens.match_batch(rows, vocab).to_pylist()
    assert [r["ids"] for r in first] == [[7, 7, 6, 7], [], [0]]
    assert sorted(asked[:3]) == ["ab", "abb", "x"] and len(asked) == 6  # three more for the plain call
    monkeypatch.setattr(tokens, "MATCHED_BYTES", 1)
    assert tokens.match_batch(rows, tokens.Matched(vocab)).to_pylist() == first


def test_masking_turns_a_key_into_a_number_only_for_random_tokens(spark):
    import hashlib

    chunks = spark.createDataFrame([("k", [CLS_ID, *range(5, 60), SEP_ID])], "k string, input_ids array<int>")
    for probability in (0.0, 0.15, 1.0):
        out = masking.mlm_mask(chunks, F.col("k"), 100, 7, 2, probability=probability)
        row = out.first()
        for i, x in enumerate(row["input_ids"]):
            key = hashlib.md5(f"7:2:k:{i}".encode()).hexdigest()
            h1, h2 = int(key[:8], 16), int(key[8:16], 16)
            picked = x not in (CLS_ID, SEP_ID) and h1 < int(probability * (1 << 32))
            masked = x if not picked or h2 >= int(0.9 * (1 << 32)) else MASK_ID if h2 < int(0.8 * (1 << 32)) else h1 % 100
            assert (row["masked_ids"][i], row["labels"][i]) == (masked, x if picked else IGNORE_LABEL)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("conv(") == 1
