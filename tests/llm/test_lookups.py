import public_tokenizers

from provlake.llm import tokens


class Counted(dict):
    looked = 0

    def __contains__(self, key):
        self.looked += 1
        return super().__contains__(key)


def test_each_distinct_piece_is_looked_for_once_a_group():
    enc = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), "words")
    want = enc.encode(["one two two", "two one xqz"])
    enc.cache = Counted()
    assert enc.encode(["one two two", "two one xqz"] * 40) == want * 40
    assert 0 < enc.cache.looked <= 3
