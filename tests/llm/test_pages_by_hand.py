"""Pages written by hand, with the text that a reader would call the article. Most of their container names stand in the labeller's lists."""

import random
from html import escape

import pytest

from pagemill.llm import html_blocks, html_extract, lstm

STORIES = [
    ("The mill on the river", ["The old mill stood at the bend of the river, where the water runs fast in spring.", "Its wheel had not turned for thirty years, and nobody knew who held the key to the door.", "Then, last winter, a light was seen in the upper window, and people began to talk."]),
    ("Ein Tag im Museum", ["Am Morgen öffnete das Museum seine Türen, und die Kinder liefen in den großen Saal.", "Dort hing ein Bild, das man aus allen Büchern kennt, doch es war viel kleiner als gedacht.", "Am Ende des Tages hatten alle müde Füße, aber sie wollten wiederkommen."]),
    ("Le train de nuit", ["Le train partit à minuit, avec un peu de retard, comme toujours en hiver.", "Dans le dernier wagon, une femme lisait à voix basse, et personne n'osait parler.", "Au matin, la mer était là, grise et calme, derrière les toits du port."]),
    ("How bread is made", ["Bread needs only flour, water, salt and time; of these, time is the one that people leave out.", "Mix the dough in the evening, cover the bowl, and let it rest in a cool place until the morning.", "Bake it hot, on a stone if you have one, and wait an hour before you cut the loaf."]),
]
#: Pages: %T title, %1 %2 %3 paragraphs.
PAGES = [
    '<body><nav><a href="/">Home</a> <a href="/n">News</a></nav><article><h1>%T</h1><p>%1</p><p>%2</p><p>%3</p><section class="comments"><p>Maria: I liked the second part best, it made me smile.</p><p>Tom: So did I.</p></section></article><footer>&copy; 2019 The Paper</footer></body>',
    '<body><article><h1>%T</h1><p>%1</p><div class="promo-box"><p>Special offer: get our magazine for half the price.</p></div><p>%2</p><p>%3</p></article></body>',
    '<body><div class="content"><h1>%T</h1><p>%1</p><p>%2</p><p>%3</p></div><div id="disqus_thread"><p>Anna wrote: my uncle told me the same story.</p></div></body>',
    '<body><main><h1>%T</h1><p>%1</p><p>%2</p><p>%3</p></main><div class="bottom">Copyright 2020 by the publisher. All rights reserved.</div></body>',
    '<body><table><tr><td><ul><li><a href="/1">Home</a></li><li><a href="/2">Archive</a></li></ul></td><td valign="top"><h1>%T</h1><p>%1</p><p>%2</p><p>%3</p></td></tr></table></body>',
    '<body><article><h1>%T</h1><p title="a > b">%1</p><p>%2</p><p>%3</p></article></body>',
    '<body><header><a href="/">Logo</a></header><div class="navbar"><a href="/a">Sport</a><a href="/b">Culture</a></div><div id="content"><h1>%T</h1><p>%1</p><p>%2</p><p>%3</p></div><div class="sidebar"><h3>Most popular</h3><ul><li><a href="/x">Ten ways to save money</a></li></ul></div></body>',
    '<body><form class="search"><p>Search this site</p></form><section class="article-body"><h1>%T</h1><p>%1</p><p>%2</p><p>%3</p></section><div class="newsletter"><p>Subscribe to our newsletter</p></div></body>',
    '<body><div class="cookie notice"><p>We use cookies to improve this site.</p></div><article><h1>%T</h1><p>%1</p><aside><p>Read more: ten mills of the north</p></aside><p>%2</p><p>%3</p></article><script>var a = "<p>no</p>";</script></body>',
    '<body><div class="post"><h1>%T</h1><div>%1</div><div>%2</div><div>%3</div></div><div class="related"><ul><li><a href="/r">Another story</a></li><li><a href="/s">And one more</a></li></ul></div><div id="footer">&copy; 2022 &middot; Contact us</div></body>',
]


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.weights_of(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_blocks_of_hand_made_pages(weights):
    right = told = there = 0
    for k, page in enumerate(PAGES):
        for title, parts in STORIES:
            wanted = [title, *parts]
            html = page.replace("%T", escape(title))
            for n, x in enumerate(parts, 1):
                html = html.replace(f"%{n}", escape(x))
            found = html_blocks.blocks(html)
            scores = lstm.predict(weights, html_blocks.features([found]))[0]
            chosen = [b.text for b, s in zip(found, scores, strict=True) if s >= 0.5]
            right += len(set(chosen) & set(wanted))
            told += len(chosen)
            there += len(wanted)
            if chosen != wanted:
                print(k, title, [(b.text[:40], round(float(s), 2)) for b, s in zip(found, scores, strict=True)])
    f1 = 2 * right / (told + there)
    print("block F1", f1)
    assert f1 >= 0.95


def test_hostile_markup():
    deep = "<div>" * 20_000 + "text" + "<div>x" * 3_000
    found = html_blocks.blocks(deep)
    assert len(found) == 3001 and max(len(b.path) for b in found) <= html_blocks.OUTER + html_blocks.INNER
    texts = lambda html: [b.text for b in html_blocks.blocks(html)]
    assert texts('<p title="a > b">Hello') == ["Hello"]
    assert texts("<p title=it's>don't</p><p>b</p>") == ["don't", "b"]
    assert texts('<p title="never closed>one</p><p>two') == ["one", "two"]
    assert texts("<p a='>' b=\">\">x<" + "</p>") == ["x<"]


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_unclosed_and_like_named_elements_hide_nothing():
    for hidden in ["<svg/>", '<svg class="i"/>', "<svg><path d='M0 0'/><text>x</text></svg>", "<svg-icon name=x></svg-icon>", "<title-bar></title-bar>", "<select-field></select-field>", "<object data=x>", "<svg>", "<select>", "<select><option>x</select>", "<template><p>x</p></template>", "<svg><title>x</title></svg >", "<SVG>x</SvG>", "<script>x</script >", "<style>x</style\n>", "<noscript>x</noscript>", "<iframe src=x></iframe>", "<textarea>x</textarea>", "<title>x</title>", "<template>"]:
        assert texts(f"<p>a</p>{hidden}<p>b</p>") == ["a", "b"], hidden
    assert texts("<p>a</p><title-bar>t</title-bar><p>b</p>") == ["a", "t", "b"]
    assert texts("<p>a</p><object data=x><p>spare</p></object><p>b</p>") == ["a", "spare", "b"]
    assert texts("<p>a</p><script>x<p>b</p>") == ["a"]  # raw text to the end, as browsers read it
    assert texts("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=x>E=m</annotation></math> is here.</p>") == ["Energy E=m is here."]


def test_many_unclosed_elements_take_linear_time():
    assert texts("<p>a</p>" + "<svg><select>" * 50_000 + "<p>b</p>") == ["a", "b"]


#: Container names that no list of the labeller holds.
UNSEEN = ["kommentare", "talkback", "meinungen", "leserpost", "zeta", "qux-panel", "impressum", "kolumne", "rubrik", "xq12", "blok", "wrapper-z", "feuilleton", "lede", "corpus-x", "stanza", "dossier", "werbung", "anzeige", "partnerlinks", "kopfzeile", "fuss", "leiste", "krumen", "suche"]
MENUS = [["Home", "News", "Sport"], ["Start", "Politik", "Kultur", "Wetter"], ["Accueil", "Monde", "Culture"], ["Shop", "Blog", "About us", "Contact"]]
READERS = [["Maria wrote: I liked the second part best.", "Tom says: So did I. Reply"], ["Posted by Jan: great article, thanks for this.", "Eva, 2 days ago: I agree."], ["Paul wrote on Monday: my uncle told me the same."]]
LEGAL = ["© 2021 The Paper. All rights reserved.", "Copyright 2020 by the publisher · Privacy policy · Terms of use", "Imprint: The Paper Ltd, 1 Mill Lane. Contact us."]
TEASERS = ["Also interesting: ten mills of the north", "Read more: how to save money", "Subscribe to our newsletter", "Advertisement", "Special offer: half the price today"]


def unseen_page(rng, k, title, parts):
    """Layout k of 40: teasers and link lists inside of the article, comments in it or behind it, menus, cookie notices, imprints."""
    box = lambda inner: f'<{(t := rng.choice(["div", "div", "section"]))} {rng.choice(["class", "id"])}="{rng.choice(UNSEEN)}">{inner}</{t}>'
    each = lambda xs: "".join(f"<p>{escape(x)}</p>" for x in xs)
    links = lambda xs: "<ul>" + "".join(f'<li><a href="/{i}">{escape(x)}</a></li>' for i, x in enumerate(xs)) + "</ul>"
    body = [f"<p>{escape(x)}</p>" if k % 5 else f"<div>{escape(x)}</div>" for x in parts]
    if k % 4 == 1:
        body.insert(1, box(each([rng.choice(TEASERS)])))
    if k % 4 == 2:
        body.insert(2, box(links(["Another story", "One more"])))
    inner = f"<h{1 + k % 2}>{escape(title)}</h{1 + k % 2}>" + "".join(body) + (box(each(rng.choice(READERS))) if k % 3 == 0 else "")
    page = box(links(rng.choice(MENUS))) if k % 2 else ""
    page += box("<p>We use cookies to improve this site.</p><p>Accept cookies</p>") if k % 7 == 0 else ""
    page += box(inner) if k % 6 else inner
    page += box(each(rng.choice(READERS))) if k % 3 == 1 else ""
    return f"<html><body>{page}{box(each([rng.choice(LEGAL)])) if k % 2 == 0 else ''}</body></html>"


def test_names_that_no_list_holds(weights):
    lists = " ".join([*html_extract.MAIN_NAMES, *html_extract.OTHER_NAMES, *html_extract.COMMENT_NAMES, *html_extract.OTHER_WORDS])
    assert not any(n in lists for n in UNSEEN)
    rng, right, told, there = random.Random(3), 0, 0, 0
    for k in range(40):
        for title, parts in STORIES:
            found = html_blocks.blocks(unseen_page(rng, k, title, parts))
            scores = lstm.predict(weights, html_blocks.features([found]))[0]
            chosen = [b.text for b, s in zip(found, scores, strict=True) if s >= 0.5]
            right, told, there = right + len(set(chosen) & {title, *parts}), told + len(chosen), there + 1 + len(parts)
    print("block F1", 2 * right / (told + there))
    # The words alone tell less than known names do; 0.90 is reached.
    assert 2 * right / (told + there) >= 0.87
