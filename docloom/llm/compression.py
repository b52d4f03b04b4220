"""zstandard dictionaries as models: lengths of short inputs under raw-content dictionaries."""

from __future__ import annotations

from functools import lru_cache

#: Bytes that stand before and after a short window, so that zstandard, which
#: never starts a match in a frame's last bytes and stores tiny frames as they
#: are, codes the window itself.  Both are in every dictionary.
CARRIER = bytes((i * 37 + 11) % 251 for i in range(48))
TAIL = bytes((i * 29 + 7) % 241 for i in range(24))


@lru_cache(64)
def compressor(content: bytes, level: int | None = None):
    import zstandard as z

    frame = {"format": z.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if level is None:  # greedy, matches of six bytes or more: for single words
        params = z.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=6, target_length=64, strategy=z.STRATEGY_GREEDY, **frame)
    else:
        params = z.ZstdCompressionParameters.from_level(level, **frame)
    if not content:
        return z.ZstdCompressor(compression_params=params)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params)


def length(content: bytes, data: bytes, level: int | None = None) -> int:
    return len(compressor(content, level).compress(data))


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary trained on the samples; their own last bytes if there are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()[-size:]
    except z.ZstdError:
        return b" ".join(samples)[-size:]
