"""Names that pages give to wrappers of their whole text."""

import pytest

from slotledger.llm import html

INNER = "<h1>A title</h1><p>First, long text of the article, with words.</p><p>Second, longer text of the article, with more words.</p>"
WANT = "A title\nFirst, long text of the article, with words.\nSecond, longer text of the article, with more words."
MENU = "<nav><ul><li>Home<li>About</ul></nav>"


@pytest.mark.parametrize("wrapped", [
    "<body class='no-sidebar'>%s</body>", "<body class='has-sidebar'>%s</body>", "<body class='sidebar'>%s</body>", "<html id=menu><body>%s</body></html>",
    "<article class='post comments-open'>%s</article>", "<div id='main' class='with-sidebar'>%s</div>", "<main class='legal'>%s</main>",
    "<form id='aspnetForm' method='post'><div>%s</div></form>", "<div class='legal'>%s</div>", "<div class='header'>%s</div>",
    "<form><div class='no-sidebar'><article class='widget'>%s</article></div></form>",
])
def test_wrappers_of_the_page_stay(wrapped):
    assert html.main_text(wrapped % (MENU + INNER)) == WANT


def test_named_furniture_goes():
    for junk in ("<div class='comments'>%s</div>", "<div class='x cookie-notice'>%s</div>", "<form>%s</form>", "<div id='sidebar'>%s</div>"):
        assert html.main_text(f"<body class='no-sidebar'><article>{INNER}{junk % '<p>Other, text.</p>'}</article></body>") == WANT
    more = "<p>Nice, post. " * 60
    assert html.main_text(f"<body><article>{INNER}</article><div class='comments'>{more}</div></body>") == WANT
    assert html.main_text(f"<body><article>{INNER}</article><aside><article>{more}</article></aside></body>") == WANT
