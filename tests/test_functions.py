import pytest

from seine.functions.html import extract_text, normalize_url, out_links
from seine.functions.porter import stem
from seine.functions.text import bigram_rows, query_tokens, simhash, token_arrays, unigram_rows


def test_tokens_and_bigrams(spark):
    docs = spark.createDataFrame([(1, "Don't foo_bar naïve C3PO"), (2, "a, b. c"), (3, ""), (4, None), (5, "one")], "doc_id long, text string")
    arrays = token_arrays(docs)
    got = {r["doc_id"]: r["t"] for r in arrays.collect()}
    assert got == {1: ["don", "t", "c3po"], 2: ["a", "b", "c"], 3: [], 4: [], 5: ["one"]}
    assert sorted(map(tuple, bigram_rows(arrays).where("doc_id = 2").collect())) == [(2, 0, "a b"), (2, 1, "b c")]
    assert unigram_rows(arrays).count() == 7 and bigram_rows(arrays).where("doc_id > 2").count() == 0
    assert query_tokens("Don't foo_bar naïve C3PO") == got[1]


def test_simhash_against_a_plain_loop(spark):
    import hashlib
    from collections import Counter

    texts = {1: "a b a c", 2: "x", 3: "", 4: "the quick brown fox jumps over the lazy dog " * 3}
    got = {r["doc_id"]: r["fp"] for r in simhash(token_arrays(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()}
    for i, t in texts.items():
        w = t.split()
        votes = Counter()
        for term in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
            h = int.from_bytes(hashlib.sha256(term.encode()).digest()[:8], "big")
            for bit in range(64):
                votes[bit] += 1 if h >> bit & 1 else -1
        assert got[i] % 2**64 == sum(1 << b for b, v in votes.items() if v > 0)


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("ponies", "poni"), ("dies", "die"), ("died", "die"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("dying", "die"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("enjoy", "enjoy"), ("is", "is")],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_html():
    text, spans = extract_text("<title>A &amp; b</title><p>x <b>bold<p>plain <h4>no</h4><script>s()</script><!-- c --><h2>head <i>it</i></h2>")
    assert text == "A & b x bold plain no s() c head it"
    assert [c for *_, c in spans] == [2, 0, 1, 0, 0, 0, 0, 1, 1] and all(text[a:b].strip() == text[a:b] for a, b, _ in spans)
    assert extract_text(None) == ("", []) and extract_text("") == ("", [])
    assert extract_text("<p>a</p><script>s()</script><!-- c -->", aside=False)[0] == "a"


def test_urls():
    assert normalize_url("HTTP://Ex.COM/a/;p?q=1#f") == "http://ex.com/a?q=1"
    assert normalize_url("//h/") == "https://h/" and normalize_url("") == "" and normalize_url("http://h") == "http://h/"
    html = '<a href="#x">1</a><a href="javascript:y">2</a><a href="mailto:z">3</a><a href=" /r ">4</a><a href="/r#t">5</a><a>6</a><a href="http://[bad">7</a><a href="">8</a>'
    assert out_links(html, "http://h/p") == ["http://h/r"]
