"""Per-row helpers: patterns, checksums, byte-pair encoding and main text, without Spark."""

import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from tokenizers import Tokenizer

from plateauscope.llm import bpe, main_text, pii, tokens, toxicity

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d)
                    or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("alphabet", ["ab.@-1%", "0123.", "012 -+().", " +1(2).-45@a", "é@a.b1"])
def test_base_spans_equal_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE] == base_spans(text)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert [s[0] for s in pii.spans_of("my ssn is 123-45-6789")] == ["ssn"]
    assert pii.spans_of("part 123-45-6789") == []
    near, far = pii.spans_of("visa card 4111111111111111")[0], pii.spans_of("4111111111111111")[0]
    assert near[3] > far[3]
    assert pii.spans_of(None) == [] and pii.spans_of("9" * 6000 + ".1.1.1") == []


def test_ibans_end_where_they_end():
    found = lambda t: [t[a:b] for kind, a, b, _ in pii.spans_of(t) if kind == "iban"]
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"
    assert found(f"IBAN {de} BIC COBADEFFXXX") == [de]
    assert found("DE89370400440532013000 EUR 50 now") == ["DE89370400440532013000"]
    assert found(f"{de} {gb} {no}") == [de, gb, no]
    assert found(f"DE88 3704 {gb}") == [gb] and found("DE88 3704 0044 0532 0130 00 BIC") == []
    assert found(f"{de}X") == [] and found(f"AB12 {no} 5") == [no]
    bban = "12345678901234567"  # of a country without entry: the longest that holds
    check = next(f"{k:02}" for k in range(2, 99) if pii.mod97(f"QX{k:02}{bban}"))
    assert found(f"bank QX{check}{bban} EUR 50") == [f"QX{check}{bban}"]
    assert pii.redacted(f"to {de} BIC", pii.spans_of(f"to {de} BIC")) == "to [IBAN] BIC"


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000,
                                  "+1" * 100_000, "+1((((" * 50_000, "AB12" * 60_000])
def test_patterns_are_linear(text):
    start = time.time()
    pii.spans_of(text)
    assert time.time() - start < 10


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


def test_encoder_equals_the_library(codec):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    rng = random.Random(3)
    texts = ["", "<|endoftext|>Hi <|startoftext|>there", "ΟΔΟΣ Σ İstanbul ß ÀÉ é \x1cy z", "<|endof",
             "don't I'll 'so '’s 1234 ½ ²", "a" * 1500, "日本語テキスト🙂🙂 emoji‍", "!!!???...--__"]
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABC'0123 .,!é日🙂", "aeinrst", "lo"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        got = codec.encode(x)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert codec.decode(got).decode() == t.decode(want, skip_special_tokens=False)


def test_encoding_is_linear(codec):
    start = time.time()
    codec.encode("ab" * 100_000)
    assert time.time() - start < 20


def test_shingle_hashes_tell_words_apart():
    texts = ["a b c d e", "A  b\nc d\te", "a b c d", "a b c d e f", "", "ab c d e f", "a b c d e"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    row, word, _, _ = tokens.words(data, offsets)
    r, h = tokens.shingles(row, word, len(texts))
    by = [set(h[r == i].tolist()) for i in range(len(texts))]
    assert by[0] == by[1] == by[6] and by[0] < by[3] and not by[4]
    assert by[2].isdisjoint(by[0]) and by[5].isdisjoint(by[3]) and len(by[3]) == 2


CASES = {
    "<article><h1>Title</h1><p>One <b>bold</b> word.<br>Next<p>Last &eacute;</article>":
        "Title One bold word. Next Last é",
    "<body><nav><a>Home</a></nav><div class='ad'>Buy</div><main><p>" + "Text here. " * 9
    + "</p><aside>side</aside><form><p>in</p></form></main><div id='comments'>nice</div>":
        ("Text here. " * 9).strip(),
    "<div class='has-sidebar'><div class='post'><p>" + "alpha " * 30 + "</p><p>beta</p></div>"
    "<div class='sidebar-left'>x</div></div>": "alpha " * 30 + "beta",
    "<script>var a='<p>no</p>'</script><style>p{}</style><p>yes  &lt;b&gt;</p><!-- no -->": "yes <b>",
    "": "", "<p></p>": "", "plain text only": "plain text only",
    "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>": "a b c d",
}


@pytest.mark.parametrize("html", list(CASES))
def test_main_text(html):
    assert main_text.main_text(html) == CASES[html]


def test_postings_of_many_queries_are_summed_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(3)
    held = [np.sort(rng.choice(20_000, 400, replace=False)).astype(np.uint64) * np.uint64(2) for _ in range(512)]
    size = np.full(512, 400)
    parts = toxicity.learnt(np.arange(512), rng.integers(0, 2, 512).astype(float), size,
                            np.concatenate(held), np.ones(512 * 400, np.int32))
    asked = [np.sort(rng.choice(20_000, 2_000, replace=False)) for _ in range(128)]
    values, place = np.arange(20_000, dtype=np.uint64) * np.uint64(2), np.concatenate(asked)
    row, n = np.repeat(np.arange(128), 2_000), np.ones(len(place), np.int64)

    def found():
        ix = toxicity.Index(parts)
        query = ix.weighted(128, values, row, place, n)
        tracemalloc.start()
        got = [(i, best.tolist(), cosine.tolist()) for i, best, cosine in ix.nearest(*query, 5)]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    whole, _ = found()
    monkeypatch.setattr(toxicity, "POSTINGS", 1 << 14, raising=False)
    pieces, most = found()
    assert pieces == whole and len(whole) == 128
    assert most < 30e6, most
