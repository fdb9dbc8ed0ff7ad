import random

import pytest

from tidebook.llm import stuffing as s

NOUNS = "bridge valley river museum orchard tower record letter market winter school railway".split()
ADJ = "old northern narrow famous shallow quiet broken".split()


def sentence(rnd):
    a, b, c = rnd.sample(NOUNS, 3)
    return rnd.choice(
        [
            f"The {rnd.choice(ADJ)} {a} was built in {rnd.randrange(1600, 1990)} by the council, which had voted to keep the {b} and the {c}.",
            f"Most of the households kept a small {a}, and the {b} was used by the village until it was moved to the {c}.",
            f"It is said that the {a} of the town was first described in a letter about the {rnd.choice(ADJ)} {b} near the {c}.",
        ]
    )


def prose(rnd, n=12):
    return "\n".join(" ".join(sentence(rnd) for _ in range(2)) for _ in range(n // 2))


def spam(rnd, kind):
    words = ["cheap widget", "buy zorgol", "discount gizmo", "zorgol gizmo online"]
    return {
        "salad": lambda: " ".join(rnd.choice(words) for _ in range(90)),
        "links": lambda: "\n".join(f"http://www.a{rnd.randrange(999)}.test/x?id={i}" for i in range(30)),
        "texts": lambda: "\n".join(f"* [https://b{i}.example/{i} {rnd.choice(words)}]" for i in range(40)),
        "tags": lambda: " ".join("#" + rnd.choice(words).replace(" ", "_") for _ in range(60)),
        "names": lambda: " | ".join(f"zorgol gizmo Name{rnd.randrange(9)}x" for i in range(60)),
        "leet": lambda: " ".join(rnd.choice(["ch34p w1dg3t", "BUY ZORGOL", "d1sc0unt"]) for _ in range(80)),
    }[kind]()


def fair(rnd, kind):
    return {
        "prose": lambda: prose(rnd),
        "glossary": lambda: "\n".join(f"; {rnd.choice(ADJ)}{i} : {rnd.choice(NOUNS)} of the {rnd.choice(NOUNS)}" for i in range(25)),
        "internal": lambda: "\n".join(f"* [[{rnd.choice(NOUNS).title()} {i}]]" for i in range(40)),
        "vandal": lambda: "potato " * 120,
        "song": lambda: "<poem>\n" + "and the broken orchard sings to the river\nrow, row to the valley\n" * 15 + "</poem>",
        "sources": lambda: "\n".join(f"# Author {rnd.choice('ABC')} ({1900 + i}). [http://c{i}.test/p ''On the {rnd.choice(ADJ)} {rnd.choice(NOUNS)} of Town{i}'']. Press, pp. {i}–{i + 9}." for i in range(25)),
        "stray": lambda: "A stub on a village.\n[http://d.test/x Town buy tickets online]",
        "decoys": lambda: prose(rnd, 6) + "\n" + "\n".join("The shop sold cheap watches until a loan was refused by the insurance office of the town." for _ in range(6)),
    }[kind]()


SPAM, FAIR = ["salad", "links", "texts", "tags", "names", "leet"], ["prose", "glossary", "internal", "vandal", "song", "sources", "stray", "decoys"]


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return s.fit([prose(rnd) for _ in range(150)] + [spam(rnd, k) for k in SPAM] + [fair(rnd, k) for k in FAIR])


def share(model, text):
    return float(s.stuffed_shares([text], model, s.Tokens(model.words))[0])


@pytest.mark.parametrize("kind", SPAM)
def test_stuffed(model, kind):
    rnd = random.Random(kind)
    assert share(model, spam(rnd, kind)) > 0.5
    short = prose(rnd, 2) + "\n" + spam(rnd, kind)
    assert share(model, short) > 0.5
    assert share(model, prose(rnd, 60) + "\n" + spam(rnd, kind)) < 0.5


@pytest.mark.parametrize("kind", FAIR)
def test_fair(model, kind):
    assert share(model, fair(random.Random(kind), kind)) < 0.3


def test_texts_do_not_touch_each_other(model):
    rnd = random.Random(5)
    texts = [spam(rnd, "salad"), "", prose(rnd), " ", "x", spam(rnd, "links"), "[[", prose(rnd), "\n"]
    together = s.stuffed_shares(texts, model, s.Tokens(model.words))
    assert [round(float(x), 9) for x in together] == [round(share(model, t), 9) if t else 0 for t in texts]


def test_rows(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd), "x") for i in range(60)] + [(100, spam(rnd, "salad"), "x"), (101, None, "x"), (102, "", "x"), (103, "  \n", "x"), (100, spam(rnd, "links") * 300, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stuffed_share string")
    model = s.train(df, "doc_id")
    got = s.score(df, "doc_id", model).collect()
    assert len(got) == len(rows) and sorted(r.doc_id for r in got if r.stuffed_share > 0.5) == [100, 100]
    assert s.train(df.limit(0), "doc_id") is None and s.score(df, "doc_id", None).where("stuffed_share > 0").count() == 0


def test_trained_on_all_documents(spark):
    rnd = random.Random(3)
    texts = [sentence(rnd) for _ in range(6000)] + [f"Zubr {i} żyje w starej puszczy nad rzeką, gdzie znaleziono go w lesie." for i in range(3)] + [None, "", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got, want = s.train(df, "doc_id"), s.fit(texts)
    assert got.words == want.words and "puszczy" in got.words
    assert (got.prose == want.prose).all() and (got.pages == want.pages).all()
    assert (got.low, got.high, got.page_high) == (want.low, want.high, want.page_high)


PHRASES = {
    "polish": "tanie buty damskie sklep internetowy kurtki zimowe torebki skórzane zegarki męskie wyprzedaż".split(),
    "arabic": "شراء أحذية رخيصة متجر حقائب ساعات عروض تخفيضات ملابس نسائية توصيل مجاني".split(),
}


def title(rnd):
    return " ".join(rnd.sample(NOUNS, 2)).title()


@pytest.mark.parametrize("kind", ["bracket", "bare", "markdown", "bbcode", "html", *PHRASES])
def test_stuffed_without_listed_words(model, kind):
    rnd = random.Random(kind)
    text = {
        "bracket": lambda: "\n".join(f"* [http://site{i}.test {title(rnd)} {i}]" for i in range(30)),
        "bare": lambda: "\n".join(f"* http://site{i}.test/ {title(rnd).lower()} number {i}" for i in range(30)),
        "markdown": lambda: "\n".join(f"- [{title(rnd)} {title(rnd)}](http://site{i}.test/a)" for i in range(30)),
        "bbcode": lambda: " ".join(f"[url=http://site{i}.test/a]{title(rnd)} {title(rnd)}[/url]" for i in range(30)),
        "html": lambda: "\n".join(f'<a href="http://site{i}.test/a">{title(rnd)} {title(rnd)}</a>' for i in range(30)),
    }.get(kind, lambda: ", ".join(" ".join(rnd.sample(PHRASES[kind], 3)) for _ in range(50)))()
    assert share(model, text) > 0.5


@pytest.mark.parametrize("kind", ["references", "templates", "three"])
def test_cited_and_stray_links_are_fair(model, kind):
    rnd = random.Random(kind)
    text = {
        "references": lambda: "\n".join(f"{sentence(rnd)}<ref>[http://c{i}.test/a {title(rnd)}]</ref>" for i in range(20)),
        "templates": lambda: "\n".join(f"* {{{{cite web|url=http://c{i}.test/a|title={title(rnd)}|date={1990 + i}}}}}" for i in range(20)),
        "three": lambda: "A stub on a village.\n" + "\n".join(f"[http://d.test/x{i} {title(rnd)}]" for i in range(3)),
    }[kind]()
    assert share(model, text) < 0.3


def test_reference_left_open_hides_no_links(model):
    links = "\n".join(f"https://site{i}.test/a" for i in range(30))
    assert share(model, "Since 1766 it has stood.<ref>Old Town\n" + links) > 0.5


def test_what_stray_links_stray_into_is_not_counted(model):
    rnd = random.Random(2)
    lines = "\n".join(f"[[Category:{title(rnd)}s of Valley{i}]]\n[[Category:{title(rnd)}s of Market{i}]]" + f"\n[http://d.test/{i} {title(rnd)}]" for i in range(5))
    assert share(model, sentence(rnd) + "\n" + lines) < 0.5


def unseen(rnd, kind):
    """Spam of words, marks and layouts that no threshold was chosen by."""
    goods = ["".join(rnd.choice("bdfglmnprstvz") + rnd.choice("aeiou") for _ in range(3)) for _ in range(8)]
    offer = lambda: " ".join(rnd.sample(goods, rnd.randrange(2, 5)))
    return {
        "bars": lambda: " | ".join(offer() for _ in range(60)),
        "lines": lambda: "\n".join(offer() for _ in range(70)),
        "stars": lambda: " ★ ".join(offer().upper() for _ in range(60)),
        "headings": lambda: "\n".join(f"== {offer()} ==" for _ in range(50)),
        "farm": lambda: "\n".join(f"<li><a href='https://{x}{i}.test/'>{offer()}</a></li>" for i, x in enumerate(goods * 5)),
        "www": lambda: ", ".join(f"www.{rnd.choice(goods)}{i}.test/{rnd.choice(goods)}" for i in range(50)),
        "hash": lambda: "\n".join(" ".join("#" + rnd.choice(goods) + rnd.choice(goods) for _ in range(6)) for _ in range(12)),
        "hidden": lambda: "<div style='display:none'>" + "; ".join(offer() for _ in range(60)) + "</div>",
    }[kind]()


@pytest.mark.parametrize("kind", ["bars", "lines", "stars", "headings", "farm", "www", "hash", "hidden"])
def test_recall_on_unseen_spam(model, kind):
    rnd = random.Random(kind)
    pages = [prose(rnd, 2) + "\n" + unseen(rnd, kind) for _ in range(20)]
    got = s.stuffed_shares(pages, model, s.Tokens(model.words))
    assert (got > 0.5).mean() >= 0.9
    assert (s.stuffed_shares([prose(rnd, 40) + "\n" + unseen(rnd, kind)[:600] for _ in range(20)], model, s.Tokens(model.words)) < 0.5).all()



@pytest.mark.parametrize("text", ["#cheapsofa #sofasale #buysofa #topsofa #sofadeals #sofaonline #bestsofa #sofastore #newsofa", "zorgol plim, cheap zorgol, zorgol quaff, plim sale, quaff plim, cheap quaff, zorgol sale, plim cheap, sale quaff"])
def test_short_pages(model, text):
    assert share(model, text) > 0.5
