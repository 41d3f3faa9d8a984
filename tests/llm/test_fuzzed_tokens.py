"""Ids of words made from odd letters, marks and punctuation, against the tokenizer itself."""

import random

from lodestone.llm.packing import END, encode


def test_fuzzed_texts():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    at = path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(at)
    r = random.Random(17)
    letters = "aAbzZéÉßẞİıŞçÇñÑüÜøØžŽΣσςΩωЖжЯяאبक日本한Ǆǅǆﬁſ" + "́̇̈ͅ" + "09²½٣" + "'’-_.,;:!?()/#@<|>\"…" + "😀"
    for _ in range(4000):
        text = "".join(r.choice(letters) if r.random() < 0.9 else r.choice(" \t\n ") for _ in range(r.randrange(1, 24)))
        assert encode(text.encode(), at).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, END], repr(text)
    for letter in map(chr, [*range(0x41, 0x250), 0x130, 0x1E9E, 0x3A3]):
        for text in (f"{letter}:", f"É{letter}!", f"{letter}{letter}.", f"a{letter}?"):
            assert encode(text.encode(), at).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, END], repr(text)
