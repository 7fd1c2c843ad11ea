"""Words and their ids in the packing operator."""

from __future__ import annotations

from mattelake.llm import hilbert_pack


def test_words_are_not_searched_again(monkeypatch):
    """New words go to the tokenizer once, without its normaliser and pattern; texts of other characters go to it whole."""
    path = hilbert_pack.default_tokenizer()
    words, seen = hilbert_pack.WordIds(path), []
    monkeypatch.setattr(words, "_encoded", lambda texts, tok, real=words._encoded: seen.append((texts, tok)) or real(texts, tok))
    texts = ["Don't stop, don't STOP", "x<|endoftext|>", "stop it's Über", ""]
    got = [ids.tolist() for ids in words.encode(texts) + words.encode(texts)]
    tok = hilbert_pack.tokenizer(path)
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts] * 2
    plain = [t for t, used in seen if used is not tok and t]
    assert plain == [["don 't stop , it 's über"]] and words.word_tok.normalizer is None
    assert list(words.values()) == list(range(len(words))) == list(range(len(words.ends) - 1))
