"""Added tokens in other cases are common text to the tokenizer."""

import pytest

from lodestone.llm.packing import END, encode


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a<|EndOfText|>b", "<|StartOfText|> The <|endoftext|>", "A<|endoftext|>B", "<|STARTOFTEXT|>.", "<|Other|> WORD, <|", "É<|ENDOFTEXT|>É"])
def test_added_tokens_in_any_case(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    at = path("word_bpe_49k.json")
    want = Tokenizer.from_file(at).encode(text, add_special_tokens=False).ids
    for _ in range(2):  # new words, then known ones
        assert encode(text.encode(), at).tolist() == [*want, END]
