"""Operators that treat each row alone: tokens, language, surrogates, TIFF, URL rules."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from folioscope.llm import bpe, langid, queries, shiftand, surrogates, tiff
from tests.conftest import SF

RANKS = bpe.read_rank_file(public_tokenizers.path(queries.RANKS))
ODD = [None, "", " ", "x", "é\n", "a" * 300_000, " " * 300_000 + "x", "Übung macht den Meister. " * 20_000]


def docs(spark, texts, **more):
    rows = [(i, t, *[v for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more))


# -- byte-level BPE -------------------------------------------------------------------------------------------------


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines() if x)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_segments_are_those_of_the_library(monkeypatch):
    codec, lib = bpe.Codec(RANKS, public_tokenizers.PATTERN), library()
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 40)
    monkeypatch.setattr(bpe, "_LONG_BLANK", re.compile(r"[ \t\r\n]{5,}"))
    rng = random.Random(1)
    parts = [*"ab é1'! \n\t\x1cß", "\u00a0", "\u3000", "'s", "      ", "\n\n\n\n\n\n", "hello", " world"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 100)))
        assert codec.encode(text) == lib.encode_ordinary(text)


def test_bpe_round_trip(spark):
    out = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    df = bpe.encode_documents(docs(spark, [*ODD, "x"], ids="clash"), RANKS, public_tokenizers.PATTERN, out=out)
    for r in df.collect():
        raw = ([*ODD, "x"][r.doc_id] or "").encode()
        assert bytes(r.decoded) == raw and r.decoded_sha256 == hashlib.sha256(raw).hexdigest() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    back = bpe.decode_documents(df.select("doc_id", "ids"), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate([*ODD, "x"])}
    assert bpe.encode_documents(docs(spark, ["x"]).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    lone = spark.createDataFrame([([128],), (None,)], "ids array<int>")
    assert bpe.decode_documents(lone, RANKS, public_tokenizers.PATTERN).count() == 2


def test_bpe_query(spark):
    lib = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_byte_bpe(spark, SF).collect():
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


@pytest.mark.parametrize("blank", ["\u3000" * 1_000_000, "\x0b" * 1_000_000, "\u00a0" + " " * 1_000_000, (" " * 1500 + "\u00a0") * 700, "\x1c" * 3000 + " " * 3000])
def test_long_runs_of_any_white_space(blank):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in (blank, "a" + blank + "b", blank + "\x1cb"):
        assert codec.decode(codec.encode(text)) == text.encode()
    short = blank[:1000]
    assert codec.encode("a" + short + "b") == library().encode_ordinary("a" + short + "b")


# -- language -------------------------------------------------------------------------------------------------------


def test_language_query(spark):
    rows = queries.op5_byte_cnn(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_edges(spark):
    texts = [*ODD, "12 34 !!", "x"]
    labelled = docs(spark, ["the cat and the dog", "der Hund und die Katze"] * 5).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', 'de') AS lang")
    net = langid.fit(labelled, "text", "lang", "doc_id", langid.Config(epochs=2))
    rows = {r.doc_id: r for r in langid.predict_languages(docs(spark, texts, score="clash"), net).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, len(ODD))] == ["und"] * 4
    assert all(rows[i].lang_pred in ("en", "de") for i in (3, 4, 5, 7))
    assert langid.fit(labelled.limit(0), "text", "lang", "doc_id") is None
    assert langid.predict_languages(docs(spark, ["hello"]), None).first().lang_pred == "und"
    one = langid.fit(labelled.where("lang = 'en'"), "text", "lang", "doc_id")
    assert langid.predict_languages(docs(spark, ["hello"]), one).first().score == 1.0


def test_letters_are_those_of_category_l():
    net = langid.ByteNet(["a", "b"])
    assert langid.predict_texts(net, ["½ ² ③", "Ⅷ 12", "_", "x", "ß", "漢", "", None])[0].count(langid.UNKNOWN) == 5
    assert all(langid.has_letter(c) == unicodedata.category(c).startswith("L") for c in map(chr, range(0x3000)))


def test_labels_are_counted_not_cut(spark):
    rows = [(i, "some text of a language", f"l{i:03d}") for i in range(257)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(df, "text", "lang", "doc_id")
    net = langid.fit(df.where("doc_id < 20"), "text", "lang", "doc_id", langid.Config(epochs=0))
    assert len(net.labels) == 20


def test_a_label_that_has_most_rows_is_sampled(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "if(id < 8900, 'the cat and the dog', 'der Hund und die Katze') AS text", "if(id < 8900, 'en', 'de') AS lang")
    seen = {}
    real = langid.ByteNet.fit
    langid.ByteNet.fit = lambda self, x, y: seen.update(y=y)
    try:
        langid.fit(df, "text", "lang", "doc_id", langid.Config(sample_rows=200))
    finally:
        langid.ByteNet.fit = real
    assert np.bincount(seen["y"]).tolist() == [100, 200], "all of the rare label, the bound of the other"


@pytest.mark.parametrize("same_text", [False, True])
@pytest.mark.parametrize("ids", ["0", "if(lang = 'en', 0, id)", "if(lang = 'en', 0, 1)"])
def test_repeated_ids_lose_no_label(spark, ids, same_text):
    """One id for all rows, for a whole label, and for each of two; texts that differ or not."""
    tail = "''" if same_text else "id"
    df = spark.range(6000).selectExpr("id", "if(id % 2 = 0, 'en', 'de') AS lang").selectExpr(
        f"{ids} AS doc_id", "lang", f"concat(if(lang = 'en', 'the cat and the dog ', 'der Hund und die Katze '), {tail}) AS text"
    )
    seen = {}
    real = langid.ByteNet.fit
    langid.ByteNet.fit = lambda self, x, y: seen.update(y=y) or real(self, x, y)
    try:
        net = langid.fit(df, "text", "lang", "doc_id", langid.Config(sample_rows=200, epochs=3))
    finally:
        langid.ByteNet.fit = real
    least = 200 if not same_text else 1
    assert all(n >= least for n in np.bincount(seen["y"], minlength=2))
    if not same_text:
        assert langid.predict_texts(net, ["der Hund und die Katze 77", "the cat and the dog 77"])[0] == ["de", "en"]


def test_forward_pass_and_gradients():
    """Against a plain loop over filters and positions, and numeric derivatives."""
    config = langid.Config(window=12, embed=3, widths=(2, 3), filters=2)
    net = langid.ByteNet(["a", "b", "c"], config)
    for name in ("table", "kernel", "bias", "head", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def naive():
        out = []
        for row in x:
            hidden = []
            for f in range(4):
                width = config.widths[f // 2]
                best = max(sum(net.table[row[at + k]][e] * net.kernel[k * 3 + e, f] for k in range(width) for e in range(3)) for at in range(12 - 3 + 1))
                hidden.append(max(best + net.bias[f], 0))
            z = np.array(hidden) @ net.head + net.offset
            out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        return np.array(out)

    assert np.allclose(net.predict(x), naive(), atol=1e-6)
    loss = lambda: -np.log(naive()[np.arange(5), y]).mean()
    grads = net._gradients(x, y)
    for name in ("kernel", "bias", "head", "offset", "table"):
        value = getattr(net, name)
        places = [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)] if name != "table" else [(int(x[0, i]), 1) for i in range(6)]
        for at in places:
            if name == "kernel" and not net.mask[at]:
                continue
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-4


def test_ties_repeats_and_empty_tables(spark):
    labelled = docs(spark, ["the cat and the dog", "der Hund und die Katze"] * 5).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', 'de') AS lang")
    net = langid.fit(labelled, "text", "lang", "doc_id", langid.Config(epochs=1))
    assert langid.predict_languages(docs(spark, ["x"]).limit(0), net).count() == 0
    twice = langid.predict_languages(docs(spark, ["the cat", "the cat"]), net).collect()
    assert twice[0].lang_pred == twice[1].lang_pred and twice[0].score == twice[1].score
    net.predict = lambda x: np.full((len(x), 2), 0.5, np.float32)
    assert langid.predict_texts(net, ["abc"]) == (["de"], [0.5]), "of equal shares the first label in order"


def test_whole_text_counts():
    net = langid.ByteNet(["a", "b"], langid.Config(window=16))
    seen = []
    net.predict = lambda x: seen.append(x.copy()) or np.full((len(x), 2), 0.5, np.float32)
    langid.predict_texts(net, ["xyz" * 1000, "q"])
    assert sum(int((x > 0).sum()) for x in seen) == 3001


# -- surrogates -----------------------------------------------------------------------------------------------------

KEY = b"test"
PII = (
    "Mr John Smith met Mrs Anna Smith. Dr JOHN Smith, господин Иванов. a.b@mail.example.com A.B@mail.example.com 4111 1111 1111 1111 4111-1111-1111-1111 "
    '+1 (743) 555-3824 10.1.2.3 8.8.4.4 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" DE89 3704 0044 0532 0130 00 078-05-1120'
)


def test_surrogates_keep_type_format_and_identity(spark):
    rows = surrogates.replace_entities(docs(spark, [PII, "John and a.b@mail.example.com", None, "", "nothing"], kinds="clash"), KEY).orderBy("doc_id").collect()
    text = rows[0].text
    before, after = surrogates.find_entities(PII), surrogates.find_entities(text)
    assert [k for *_, k, _ in before] == rows[0].kinds and rows[0].n_entities == len(before)
    assert not {v for *_, v in before} & {v for *_, v in after}
    names = [v for *_, k, v in after if k.startswith("name")]
    assert names[1] == names[3] == names[5] and names[0].upper() == names[4], "one person keeps one name"
    assert surrogates.script_of(names[6]) == "CYRILLIC"
    cards = [v for *_, k, v in after if k == "card"]
    assert cards[0].replace(" ", "") == cards[1].replace("-", "") and surrogates.luhn(cards[0].replace(" ", ""))
    assert surrogates._iban_rest(surrogates.surrogate(KEY, "iban", "DE89370400440532013000")) == 1
    ips = [v for *_, k, v in after if k == "ip"]
    assert ips[0].startswith("10.") and not ips[1].startswith("10.")
    assert "a.b@mail" not in rows[1].text and rows[1].text.split()[-1].lower() in text.lower()
    assert [(r.text, r.n_entities) for r in rows[2:]] == [(None, 0), ("", 0), ("nothing", 0)]


NUMBERS = ["+14155550123", "4155550123", "+49 30 1234567", "(030) 1234567", "+44 20 79460958", "555-3824", "+49 (0)30 1234567", "+4915112345678", "030/1234567", "1-415-5550123"]


@pytest.mark.parametrize("number", NUMBERS)
@pytest.mark.parametrize("around", ["Reach us: {} today.", "{}", "{} 10.1.2.3"])
def test_forms_of_phone_numbers(number, around):
    text = around.format(number)
    assert ("phone", number) in [(k, v) for *_, k, v in surrogates.find_entities(text)]
    changed = surrogates.replaced(text, KEY, {})[0]
    assert number not in changed and "phone" in [k for *_, k, _ in surrogates.find_entities(changed)]


def test_phone_numbers_by_context():
    assert [v for *_, v in surrogates.find_entities("Phone: 5553824, or call me at 1234 5678.")] == ["5553824", "1234 5678"]
    assert not surrogates.find_entities("order 5553824 of 2023-05-12, 2019-2020, 12.05.2023, 10000000 and 120000 450000, 1700000000 s")


def test_all_words_of_a_name_and_later_mentions():
    text = "Mr John Ronald Smith came. SMITH and Smith's wife met Herr Dr. Ludwig van Moser and Mr J. R. Hill. The Moser-Hill plan, a hill, Ronald."
    words = [v for *_, v in surrogates.find_entities(text)]
    assert words == ["John", "Ronald", "Smith", "SMITH", "Smith", "Ludwig", "Moser", "J", "R", "Hill", "Moser", "Hill", "Ronald"]
    changed = surrogates.replaced(text, KEY, {})[0]
    assert not re.search("(?i)john|ronald|smith|ludwig|moser|Hill", changed.replace("a hill", ""))
    new = changed.split()
    assert new[3].rstrip(".") == new[7].removesuffix("'s") == new[5].title()


def test_names_do_not_overlap():
    found = surrogates.find_entities("Mr O'Brien and Frau Anna-Moser's cat. Herr Moser, O'Brien's, Anna-Moser")
    assert [v for *_, v in found] == ["O'Brien", "Anna-Moser", "Moser", "O'Brien", "Anna-Moser"]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("secret", ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uhbU", "SG.a1b2c3d4e5f6g7h8.i9j0"])
def test_secrets_run_over_dots(secret):
    assert [(k, v) for *_, k, v in surrogates.find_entities(f"token: {secret}. Then")] == [("secret", secret)]
    assert not surrogates.find_entities("token = self.tokenizer.next_token")
    assert not any(part in surrogates.replaced(f"token: {secret}", KEY, {})[0] for part in secret.split(".") if len(part) > 3)


def test_bijection():
    seen = {tuple(surrogates.permuted(KEY, "t", [a, b, c], [3, 4, 5])) for a in range(3) for b in range(4) for c in range(5)}
    assert len(seen) == 60
    assert len({surrogates.surrogate(KEY, "phone", f"+1743555{i:04d}") for i in range(2000)}) == 2000


def test_texts_that_no_surrogate_may_crash(spark):
    """Values without an ASCII letter or digit, other scripts, and formats that are full."""
    odd = [
        "Password: ----------------", "token=________________", "mail иван@почта.рф now", "mail ΝΙΚΟΣ@ταχ.ελ and é.ñ@ü.fr", "secret: пароль1234567890секрет", "secret = ٠١٢٣٤٥٦٧٨٩٠١٢٣٤٥٦٧", "Mr Ян", "x" * 200_000 + " a@b.org", None, "",
    ]
    rows = {r.doc_id: r for r in surrogates.replace_entities(docs(spark, [*odd, odd[2]]), KEY).collect()}
    assert rows[0].text == odd[0] and rows[1].text == odd[1] and rows[0].n_entities == 0
    for i in (2, 3, 4, 5):
        for *_, value in surrogates.find_entities(odd[i]):
            assert value not in rows[i].text
            assert {unicodedata.name(c).split()[0] for c in value if c.isalpha()} == {unicodedata.name(c).split()[0] for c in surrogates.find_entities(rows[i].text)[0][3] if c.isalpha()} or i == 3
    assert rows[2].text == rows[len(odd)].text, "repeated rows fare alike"
    assert rows[7].text.endswith(".org") and rows[8].text is None
    assert surrogates.replace_entities(docs(spark, odd).limit(0), KEY).count() == 0


def test_many_short_names_and_a_full_network(spark):
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    names = [a.upper() + b + c for a in letters for b in letters for c in letters][:12_000]
    texts = [". ".join(f"κύριος {n}" for n in names[i : i + 100]) for i in range(0, len(names), 100)]
    texts += [" ".join(f"192.168.{i}.{j}" for j in range(256)) for i in range(256)]
    made = surrogates.surrogate_table(docs(spark, texts), KEY)
    rows = made.collect()
    for kind, want in (("name", 12_000), ("ip", 65_536)):
        some = [r for r in rows if r.kind.startswith(kind)]
        assert len(some) == want == len({r.surrogate for r in some})
    assert not {r.surrogate for r in rows if r.kind.startswith("name")} & set(n.lower() for n in names)
    assert sum(r.surrogate == r.entity for r in rows if r.kind == "ip") <= 2
    assert made.rdd.getNumPartitions() >= 1


@pytest.mark.parametrize("kind,value", [("email", "иван@почта.рф"), ("email", "é.b@x.org"), ("card", "4111111111111111"), ("ssn", "078-05-1120"), ("ip", "8.8.4.4"), ("ip", "172.20.1.1"), ("phone", "+14155550123"), ("secret", "abcdef0123456789abcd"), ("secret", "пароль12345678секрет"), ("iban", "DE89370400440532013000")])
def test_each_attempt_stays_in_its_format(kind, value):
    for attempt in range(6):
        assert surrogates.format_of(kind, surrogates.surrogate(KEY, kind, value, attempt)) == surrogates.format_of(kind, value)


@pytest.mark.parametrize("shared", [100_000, 0])
def test_planted_data_by_another_detector(spark, monkeypatch, shared):
    """A planted corpus through replace_entities on both paths of the exceptions; what was planted is known, so nothing here relies on the detector."""
    monkeypatch.setattr(surrogates, "MAX_SHARED", shared)
    rng = random.Random(12)
    mails = [f"{''.join(rng.choices('abcdefgh', k=2))}@{rng.choice('xyz')}.org" for _ in range(60)]  # two letters and one: collisions are certain
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004"]
    people = ["Smith", "Jones", "Иванов", "Moser"]
    texts = []
    for i in range(120):
        words = [f"plain{rng.randrange(50)}" for _ in range(6)]
        planted = rng.sample(mails, 2) + [rng.choice(cards), f"Mr {people[i % 4]}", people[i % 4]]
        texts.append((" ".join(w for pair in zip(words, [*planted, ""]) for w in pair), planted))
    rows = surrogates.replace_entities(docs(spark, [t for t, _ in texts]), KEY).collect()
    image: dict[str, str] = {}
    for r in rows:
        before, planted = texts[r.doc_id]
        old, new = before.split(), r.text.split()
        assert [w for w in old if w.startswith("plain")] == [w for w in new if w.startswith("plain")], "all else stays"
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            if "@" in a or a in people:
                assert b != a and image.setdefault(a, b) == b, "one surrogate for each entity, everywhere"
                assert ("@" in a) == ("@" in b) and len(a) == len(b) or a in people
        assert surrogates.luhn("".join(w for w in new if w.isdigit())) and not any(c in r.text for c in cards)
    assert len(set(image.values())) == len(image)
    assert not set(image.values()) & {m for _, p in texts for m in p if "@" in m}, "no surrogate is another real address"


@pytest.mark.parametrize("shared", [100_000, 0])
def test_collisions_are_made_anew(spark, monkeypatch, shared):
    monkeypatch.setattr(surrogates, "MAX_SHARED", shared)
    real = surrogates.surrogate

    def crowded(key, kind, entity, attempt=0):
        return "zz@example.com" if kind == "email" and attempt == 0 else real(key, kind, entity, attempt)

    monkeypatch.setattr(surrogates, "surrogate", crowded)
    texts = ["a@x.org", "b@x.org", "c@x.org b@x.org", "zz@example.com"]
    made = surrogates.surrogate_table(docs(spark, texts), KEY, make=crowded).collect()
    assert len({r.surrogate for r in made}) == 4 and not {r.surrogate for r in made} & {r.entity for r in made}


def test_pii_query(spark):
    rows = queries.op2_pii_surrogates(spark, SF).collect()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    hit = [r for r in rows if r.n_entities]
    assert len(rows) == len(source)
    assert all(r.text == source[r.doc_id] for r in rows if not r.n_entities)
    for r in hit:
        for *_, value in surrogates.find_entities(source[r.doc_id]):
            assert value not in r.text


# -- TIFF -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, tile, predictor):
    rng = random.Random(7)
    for rows in (1, 5, 999):
        payload = bytes(rng.choice([0, 0, 0, 65, rng.randrange(256)]) for _ in range(64 * rows))
        stored = tiff.write_payload(payload, tiff.Layout(page_rows=300, strip_rows=77, tile=tile, compression=compression, predictor=predictor))
        pages = list(tiff.read_pages(stored))
        assert b"".join(p.samples for p in pages) == payload and len(pages) == -(-rows // 300)


def test_big_endian_and_broken_files(spark):
    import struct

    entries = [(256, 3, 2), (257, 3, 1), (258, 3, 16), (259, 3, 1), (273, 4, 8), (278, 3, 1), (279, 4, 4)]
    ifd = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in entries) + b"\0\0\0\0"
    file = b"MM\0*" + struct.pack(">I", 12) + b"\1\2\3\4" + ifd
    (page,) = tiff.read_pages(file)
    assert (page.width, page.bits, page.samples) == (2, 16, b"\1\2\3\4")
    clash = spark.createDataFrame([(7, "w", 1.5, file)], "k int, width string, samples double, media binary")
    assert [(r.k, r.width, bytes(r.samples)) for r in tiff.tiff_pages(clash).collect()] == [(7, 2, b"\1\2\3\4")]
    loop = file[:-4] + struct.pack(">I", 12)
    good = tiff.write_payload(bytes(128), tiff.Layout(page_rows=1))
    df = spark.createDataFrame([(1, good), (2, None), (3, b"no"), (4, loop), (5, good[:-9]), (1, good)], "page int, media binary")
    rows = tiff.tiff_pages(df.withColumnRenamed("page", "k")).collect()
    assert sorted((r.k, r.page) for r in rows if r.error is None) == [(1, 0), (1, 0), (1, 1), (1, 1), (4, 0), (5, 0)]
    assert sorted(r.k for r in rows if r.error) == [2, 3, 4, 5]
    rng = random.Random(3)
    for _ in range(300):  # damage never does anything but TiffError
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            list(tiff.read_pages(bytes(bad)))
        except tiff.TiffError:
            pass


def test_tiff_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_tiff(spark, SF).collect():
        raw = texts[r.doc_id]
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    seen = {re.search("compression=([0-9]+);predictor=([0-9])", r.feature).groups() for r in queries.op6_tiff(spark, SF).collect()}
    assert seen == {(str(c), p) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in "12"}, "the query writes and reads all of them"
    odd = {r.doc_id: r for r in tiff.store_texts(docs(spark, [*ODD, ODD[4]], feature="clash"), layouts=tiff.LAYOUTS, media=True).collect()}
    assert odd[len(ODD)].media == odd[4].media
    assert odd[0].payload_bytes == 64 and odd[0].media_sha256 == odd[1].media_sha256 == hashlib.sha256(odd[1].media).hexdigest()
    assert tiff.store_texts(docs(spark, ["x"]).limit(0)).count() == 0


# -- URL rules ------------------------------------------------------------------------------------------------------


def test_automaton_is_the_glob():
    rng = random.Random(5)
    pats = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", ".", "c"]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    automaton = shiftand.Automaton([p.encode() for p in pats])
    assert automaton.words > 4
    texts = ["".join(rng.choice("ab/.cx") for _ in range(rng.randint(0, 14))) for _ in range(1000)]
    final = automaton.run([t.encode() for t in texts])
    for p, bit in zip(pats, automaton.last, strict=True):
        tokens = re.findall(r"\*\*|.", p)
        regex = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in tokens), re.S)
        got = (final[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        assert [bool(regex.fullmatch(t)) for t in texts] == [bool(x) for x in got]


def test_url_rules(spark):
    urls = [
        "http://A.Example.org/es/1", "http://example.org/en/12?x", "http://example.org", "https://example.com/fr/a", "https://x.com/de/", "http://a.com/x.org/es/", "ftp://xexample.org/es/", None, "", "no scheme.org/",
        "http://b.example.org/en/1#/es/", "http://" + "a" * 50_000 + ".org/" + "b" * 50_000, "http://é.org/", "x://y://z.org/",
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in shiftand.judge_urls(df, queries.URL_RULES, default="block").collect()}

    def brute(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "block")

    assert got == {i: tuple(brute(u)) for i, u in enumerate([*urls, urls[0]])}
    assert shiftand.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert shiftand.judge_urls(df, []).where("rule IS NULL AND verdict = 'allow'").count() == len(urls) + 1
