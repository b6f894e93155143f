from lodestone.llm.html_text import main_text

LONG = ("A sentence that is long enough to be an article of its own kind. " * 8).strip()


def test_what_follows_an_inserted_block_stays():
    advert = "".join(f'<div class="advert">Buy number {i}</div>' for i in range(4))
    form = "<form><p>Name</p><p>Street</p><p>Town</p><p>Send</p></form>"
    for block in (advert, form):
        assert main_text(f"<div>{LONG}</div>{block}<p>The end.</p>") == f"{LONG}\nThe end."


def test_small_regions_stay():
    links = "".join(f"<div><a href=x>Entry {i}</a></div>" for i in range(4))
    tail = "A closing paragraph that is well above the surge threshold of eighty characters, but small."
    assert main_text(f"<div>{LONG}</div>{links}<p>{tail}</p>") == f"{LONG}\n{tail}"
