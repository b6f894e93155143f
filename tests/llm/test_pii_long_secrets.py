import random
import string

from lodestone.llm import pii


def token(rng, n):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=n))


def test_tokens_of_any_length_and_shape_are_proposed_whole():
    rng = random.Random(4)
    jwt = ".".join([token(rng, 36), token(rng, 240), token(rng, 43)])
    for body in (token(rng, 240), "0123456789abcdef" * 20, jwt, "".join(rng.choices(string.ascii_letters, k=90)) + "7", "".join(rng.choices(string.ascii_letters, k=40)), token(rng, 100000)):
        for text in (f'the api token = "{body}" anon', f"token: {body}. Next 1", f"bearer {body}"):
            at = text.index(body)
            assert ("secret", at, at + len(body)) in pii.candidates(text), (len(body), text[:20])


def test_long_tokens_are_redacted_whole():
    rng, model = random.Random(6), pii.judge()
    for body in (token(rng, 240), ".".join([token(rng, 36), token(rng, 240), token(rng, 43)])):
        text = f'the api token = "{body}" anon'
        assert pii.redact(text, pii.all_spans(text, model)[1]) == 'the api token = "[SECRET]" anon'
