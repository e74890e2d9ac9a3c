"""Operators that map one document to one result, against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rosterlake.llm import bpe, chat, language, licenses, pii, toxicity
from rosterlake.llm.common import TEXTS_AT_ONCE, text_function

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


# text functions ------------------------------------------------------------------------------------------------------
def test_workers_hold_few_results_at_once(spark):
    class Result(list):
        alive = 0

        def __init__(self, text):
            Result.alive += 1
            super().__init__((text.decode(), Result.alive))

        def __del__(self):
            Result.alive -= 1

    n = 8 * TEXTS_AT_ONCE + 3
    df = spark.range(n, numPartitions=1).selectExpr("id", "IF(id = 5, NULL, concat('t', id)) AS text")
    got = df.select("id", text_function(lambda t: Result(t), "text string, alive int")("text").alias("r")).collect()
    assert [(r["id"], r["r"]["text"]) for r in got] == [(k, "" if k == 5 else f"t{k}") for k in range(n)]
    assert max(r["r"]["alive"] for r in got) <= 2 * TEXTS_AT_ONCE


# personal data -------------------------------------------------------------------------------------------------------
PATTERNS = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
            ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def test_pii_matches_plain_patterns(spark):
    random.seed(5)
    alphabet = list("ab1204@..+-_ ()é😀") + ["4041894974608795", "1.2.3.4", "a@b.cd", "+1 (988) 555-2485"]
    texts = ["".join(random.choices(alphabet, k=60)) for _ in range(150)]
    texts += [None, "", "a@b.c_d@e.f", "0255.1.1.1 256.1.1.1", "a" * 30000 + "@", "1 " * 20000, "a@" + "b." * 20000 + "c"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "x@y.zz")]
    found = pii.find(spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS + ", _done string")).collect()
    assert len(found) == len(rows)
    for row in found:
        want = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS) for m in p.finditer(row["text"] or "") if confirmed(k, m.group()))
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in row["pii"] if s["rank"] < 4] == want


def test_pii_scores_read_the_forty_characters_before(spark):
    random.seed(8)
    bits = ["a@b.cd", "+1 (988) 555-2485", "4041894974608795", "ssn ", "card", " visa é", "order ", "123-45-6789", ", ", "call ", "1.2.3.4 ", "version", "x" * 30]
    texts = ["".join(random.choices(bits, k=25)) for _ in range(80)]
    for row in pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect():
        for s in row["pii"]:
            before = row["text"][max(0, s["start"] - pii.CONTEXT):s["start"]].lower()
            moved = pii.START[s["kind"]] + pii.STEP * bool(re.search(pii.RAISING[s["kind"]], before)) - pii.STEP * bool(re.search(pii.LOWERING, before))
            assert abs(s["score"] - min(max(moved, 0), 1)) < 1e-9 and row["text"][s["start"]:s["end"]] == s["match"]


def test_pii_texts_that_are_all_matches(spark):
    texts = ["12, " * 60000, "a@b.cd " * 15000, "1.2.3.4 " * 15000, "4041894974608795, " * 6000, "é+1 (988) 555-2485; " * 6000]
    rows = {r["doc_id"]: r["pii"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [len(rows[i]) for i in range(5)] == [0, 15000, 15000, 6000, 6000]
    assert [rows[i][-1]["end"] for i in range(1, 5)] == [len(texts[i].rstrip(", ;")) for i in range(1, 5)]


def test_pii_method_spans_and_redaction(spark):
    df = spark.createDataFrame([(1, "my bank account DE89 3704 0044 0532 0130 00, ssn 123-45-6789"), (2, "order 123-45-6789 DE88370400440532013000")], DOCS)
    rows = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert [s["kind"] for s in rows[1]["pii"]] == ["iban", "national_id"] and rows[2]["pii"] == []
    shown = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(df)).collect()}
    assert shown[1] == "my bank account [iban], ssn [national_id]"


# BPE -----------------------------------------------------------------------------------------------------------------
def whole(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_equals_whole_encoding(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    random.seed(2)
    alphabet = list("ab cdE'sé,.;:!?<=>0123 \n\t") + ["<|endoftext|>", "́", "̸", "ß", "Σ", "İ", "漢", "😀", " ", "\x85", "'ll", "x" * 300, "ᄀ", "ᅡ"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 900))) for _ in range(150)] + [None, "", "a" * 20000, "ab," * 9000]
    for row in bpe.encode(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect():
        t = row["tokens"]
        assert (t["n_tokens"], bytes(t["ids"]), t["decoded"]) == whole(tokenizer, row["text"])


def test_bpe_small_tables_and_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 4)
    path = public_tokenizers.path(bpe.TOKENIZER)
    encoder, tokenizer = bpe.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = [" ".join(random.choices("one two three four, five. six".split(), k=200)) for _ in range(30)]
    assert [encoder.encode(t.encode()) for t in texts] == [whole(tokenizer, t) for t in texts]
    df = spark.createDataFrame([([320, 321],), (None,)], "ids array<long>")
    assert [r["text"] for r in bpe.decode(df).collect()] == [tokenizer.decode([320, 321], skip_special_tokens=False), None]


# licences ------------------------------------------------------------------------------------------------------------
def test_license_base_phrases(spark):
    texts = [None, "", "MIT License mit license. CC-BY cc by", "GNU General\nPublic License; apache licenses", "mit " * 9000 + "license", "Apache License"]
    for row in licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect():
        words = WORD.findall(lowered(row["text"]))
        hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        found = row["licenses"]
        assert (found["n_words"], found["n_base"]) == (len(words), len(hits))
        assert (found["first_word"], found["last_word"]) == (min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert found["base_labels"] == ",".join(sorted({label for _, label in hits}))
        assert set(filter(None, found["base_labels"].split(","))) <= set(found["labels"].split(",")) and 0 <= found["score"] <= 1


def test_license_template_with_inserted_words():
    text = b"x y Redistribution and use in source OR and binary forms, with or without modification, are permitted provided that the following conditions are met z"
    (label, start, end, cover), = licenses.Scanner().spans(licenses.word_bytes(text))
    assert (label, start, end) == ("bsd", 2, 24) and cover == 1.0


def test_license_places_in_long_texts_and_body_paragraphs(spark):
    text = "mit license " * 100_000
    found = licenses.Scanner().base_places(licenses.word_bytes(text.encode()))
    assert found == [(2 * i, "mit") for i in range(100_000)]
    bodies = [t for _, t in licenses.TEMPLATES]
    rows = licenses.scan(spark.createDataFrame([(i, f"Some words before it. {t} and after.", "clash") for i, t in enumerate(bodies)],
                                               DOCS + ", labels string")).collect()
    for row in rows:
        label, words = licenses.TEMPLATES[row["doc_id"]][0], WORD.findall(lowered(bodies[row["doc_id"]]))
        assert label in row["licenses"]["labels"].split(",") and row["licenses"]["score"] == 1.0 and row["labels"] == "clash"
        assert (label, 4, 4 + len(words)) in {(s["label"], s["start"], s["end"]) for s in row["licenses"]["spans"]}


def test_license_chains_are_the_best_ones():
    random.seed(6)
    for _ in range(300):
        matches = sorted({(random.randrange(30), random.randrange(12), random.randint(4, 7)) for _ in range(random.randint(1, 9))})

        def best(i):
            start, place, size = matches[i]
            return size + max((best(j) for j, (s, p, n) in enumerate(matches) if j != i and 0 <= start - s - n <= licenses.MOST_GAP
                               and 0 <= place - p - n <= licenses.MOST_GAP), default=0)
        assert [c for c, _, _ in licenses.Scanner._chains(matches)] == [best(i) for i in range(len(matches))]


def test_license_chain_survives_a_stray_match():
    words = licenses.word_bytes(licenses.TEMPLATES[0][1].encode())
    at = len(words) // 2
    text = words[:at] + [b"zz"] + words[2:7] + [b"zz"] + words[at:]
    spans = [s for s in licenses.Scanner().spans(words[:at] + [b"zz"] + words[at:]) if s[0] == "mit"]
    assert spans == [("mit", 0, len(words) + 1, 1.0)]
    # a stray repeat wider than the gap ends the chain; neither half covers enough
    assert [s for s in licenses.Scanner().spans(text) if s[0] == "mit"] == []


def test_suffix_automaton_statistics():
    random.seed(3)
    runs = [random.choices([b"a", b"b", b"c"], k=8) for _ in range(4)]
    automaton = licenses.SuffixAutomaton(runs)
    for _ in range(100):
        text = random.choices([b"a", b"b", b"c", b"d"], k=15)
        for i, (size, state) in enumerate(automaton.statistics(text)):
            assert size == max(k for k in range(i + 2) if k == 0 or any(q[j:j + k] == text[i + 1 - k:i + 1] for q in runs for j in range(len(q))))
            if size:
                assert automaton.ends[state] == {(t, p) for t, q in enumerate(runs) for p in range(size - 1, len(q)) if q[p + 1 - size:p + 1] == text[i + 1 - size:i + 1]}


# chat ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("messages", [[("user", "<|im_end|>\\<\\|\n"), ("a\n\\n", ""), ("assistant", "\\")], []])
def test_chat_round_trip(messages):
    formatted, mask = chat.render(messages)
    assert chat.parse(formatted) == messages
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in messages if r == "assistant"]


def test_chat_folds_events(spark):
    events = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 3, "regenerate", "assistant", ""),
              (1, 1, 4, "delta", "assistant", "yo"), (1, 2, 1, "message", "user", "z"), (1, 2, 2, "edit", "user", "q"), (1, 3, 0, "message", "user", "gone"),
              (1, 3, 1, "remove", None, None), (2, 0, 0, "message", "user", "same"), (2, 0, 0, "message", "user", "same"), (None, None, None, None, None, None)]
    random.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, turn long, seq int, kind string, role string, text string")
    found = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_events(df).collect()}
    assert found == {1: [("user", "hi"), ("assistant", "yo"), ("user", "q")], 2: [("user", "same")] * 2, None: [("", "")]}
    assert chat.format_events(df.limit(0)).count() == 0


# models --------------------------------------------------------------------------------------------------------------
def test_language_learns_and_handles_gaps(spark):
    random.seed(1)
    said = {"en": "the house and the garden of this town", "de": "der garten und das haus einer stadt", "fr": "le jardin et la maison de cette ville", "zz": "qa qo qi zu zo"}
    rows = [(i, " ".join(random.choices(said[lang].split(), k=12)), lang) for i, lang in enumerate(list(said) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 ?", "fr"), (902, "le la", None)], DOCS + ", lang string")
    model = language.fit(df)
    found = {r["doc_id"]: (r["lang"], r["language"]) for r in language.predict(df, model).collect()}
    assert all(guess["lang"] == lang and 0 <= guess["score"] <= 1 for i, (lang, guess) in found.items() if i < 900)
    assert found[900][1]["lang"] == found[901][1]["lang"] == "und" and found[902][1]["lang"] == "fr"
    assert language.fit(df.limit(0)).decide(b"hello") == ("und", 0.0)


def test_toxicity_learns_words_and_tolerates_insertions(spark):
    random.seed(4)
    plain = [a + b + c for a in ("on", "re", "th", "st", "la") for b in ("an", "er", "ti", "mo") for c in ("ing", "ed", "ly", "nd")]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = random.choices(plain, k=40) + ([random.choice(["grumblehead", "snarkwit"])] * 2 if bad else [])
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*marks, (5, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    assert all((scorer.score(t.encode()) >= toxicity.THRESHOLD) == bool(y) for (_, t), (_, y) in zip(rows, marks))
    for said in (b"onaned grum-ble.head snarkwitt laering", b"s n a r k w i t and grumbblehead"):
        assert scorer.score(said) > scorer.score(b"onaned laering thmoly")
    kept = toxicity.keep_clean(docs.selectExpr("*", "1 AS _score", "2 AS _whole"), scorer)
    assert kept.columns == ["doc_id", "text", "_score", "_whole"] and kept.count() == 300
    assert toxicity.fit(docs, labels.where("toxic = 0")).score(b"snarkwit") == 0.0
    empty = toxicity.score(spark.createDataFrame([(1, None), (2, "")], DOCS), scorer).collect()
    assert all(0 <= r["toxicity"] <= 1 for r in empty)




def test_language_letters_and_repeated_ids(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in [("the cat and the dog are here", "en"), ("der Hund und die Katze sind da", "de")][i % 2:i % 2 + 1]]
    again = [(1, "the cat and the dog are here", "en"), (3, "der Hund und die Katze sind da", "de"), (5, "½", "fr")]
    schema = DOCS + ", lang string"
    model = language.fit(spark.createDataFrame(rows + again, schema))
    other = language.fit(spark.createDataFrame((again + rows)[::-1], schema).repartition(7))
    assert "fr" not in model.within and set(model.families.classes) == {"germanic"}
    texts = [b"the dog", b"die Katze", "½ ② Ⅷ ²".encode(), b"12_3", b""]
    assert [model.decide(t) for t in texts] == [other.decide(t) for t in texts]
    assert [model.decide(t)[0] for t in texts] == ["en", "de", "und", "und", "und"]
