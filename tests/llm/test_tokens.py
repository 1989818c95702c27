"""Codec, packing, token files and chat trees: exact round trips."""

import glob
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import bpe_codec, chat_tree, common, packing, token_file, tokens

PIECES = [" ", "  ", "\n", "\t", "a", "Bc", "1", "'s", ".", "\xa0", "é", "\r\n", "<|endoftext|>", " x", "\x1c", "　", "漢字", "🙂"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["", " ", "word", "x" * 5000] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_remembered_pieces_give_the_ids_of_whole_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(tokens, "CACHE_PIECE", 6)
    e = tokens.PieceEncoder(tokens.default_vocabulary())
    own = texts(1)
    for i in range(0, len(own), 64):
        for t, got in zip(own[i : i + 64], e.encode(own[i : i + 64]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_even_texts(library, monkeypatch):
    """Words between single blanks, most of them seen before, among other texts."""
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 60)
    rng, e = random.Random(21), tokens.PieceEncoder(tokens.default_vocabulary())
    word = lambda: rng.choice(["the", "The", "é", "naïve\nline", "x1.", "don't", "漢字", "🙂", "a" * 60]) if rng.random() < 0.6 else "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    for _ in range(6):
        own = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(20)] + ["", "one", " lead", "two  blanks", "a\xa0b", "x <|endoftext|> y"]
        rng.shuffle(own)
        for t, got in zip(own, e.encode(own), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    assert e.encode([]) == []


def test_added_tokens_in_texts(library):
    end, e = "<|endoftext|>", tokens.PieceEncoder(tokens.default_vocabulary())
    own = [end, f"a {end} b", f"{end} a", f"a {end}", f"word{end}word", f"a\xa0{end}\u3000b", f"  {end}\t{end}", f"<|endof {end}text|>", "<|endoftext |>", f"a {end[:-1]}", "x" * 100 + end]
    for t, got in zip(own, e.encode(own), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u2").tolist() == ids
        assert (50256 in ids) == (end in t)
    # what was remembered before is right after such texts too
    assert np.frombuffer(e.encode(["a b"])[0], "<u2").tolist() == library.encode("a b", add_special_tokens=False).ids


def test_safe_pieces_and_raw_bytes(monkeypatch):
    c = bpe_codec.codec(*bpe_codec.default_ranks())
    monkeypatch.setattr(bpe_codec, "LONG_TEXT", 7)
    for t in texts(2):
        assert "".join(bpe_codec.safe_pieces(t, 7)) == t
        ids = c.encode(t)
        assert ids == c.encoding.encode_ordinary(t)
        assert c.decode(ids[:3]) + c.decode(ids[3:]) == t.encode()


def test_codec_rows(spark):
    rows = [(1, "héllo"), (None, None), (2, ""), (2, "")]
    got = bpe_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in got) == sorted((str(d), t or "") for d, t in rows)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    assert bpe_codec.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    sources = ["a"] * 6 + ["b", "b", "c", None] + [f"rare{i}" for i in range(5)]
    own = [(i, " ".join(rng.choice(["the", "of", "pleural", "é"]) for _ in range(rng.randrange(300))), rng.choice(sources)) for i in range(n)]
    return own + [(None, None, None), (700, "twice", "a"), (700, "twice", "a")]


def check_pieces(rows, pieces, library, window=2048, keyed=True):
    length = {}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    ids = defaultdict(list)
    for d, t, s in rows:
        ids[d].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
        length[s] = length.get(s, 0) + len(ids[d][-1])
    for p in pieces:
        assert p["length"] > 0
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["source"]))
        if len(ids[p["doc_id"]]) == 1:
            own = ids[p["doc_id"]][0]
            assert p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
            by_doc[p["doc_id"]].append((p["start"], p["length"]))
    for d, found in by_doc.items():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == len(ids[d][0])
    assert sum(p["length"] for p in pieces) == sum(length.values())
    served, total = defaultdict(int), sum(length.values())
    worst = 0.0
    for q in range(max(by_sequence) + 1):
        at = 0
        for offset, n, s in sorted(by_sequence[q], key=lambda x: x[0]):
            assert offset == at
            at += n
            served[s] += n
        assert at <= window and (at == window or q == max(by_sequence) or not keyed)
        if q < max(by_sequence):
            worst = max(worst, max(abs(served[s] - (q + 1) * window * n / total) for s, n in length.items() if n * window >= total))
    return worst


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(spark, library, window):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    worst = check_pieces(rows, packing.pack(docs, window=window).collect(), library, window)
    # no source is ever a token away from its share, but the one that small sources follow
    assert worst < 1 or window == 64


def test_packing_towards_targets(spark, library):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, window=256, targets={"a": 1.0, "b": 1.0}).collect()
    check_pieces(rows, pieces, library, 256, keyed=False)
    first = [p for p in pieces if p["sequence_id"] < 4]
    share = {s: sum(p["length"] for p in first if p["source"] == s) for s in ("a", "b")}
    assert abs(share["a"] - share["b"]) <= 2 and sum(share.values()) == 4 * 256


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0, "b": 2.0, None: 4.0}, {"b": 1.0, "c": 1.0, "nowhere": 1.0}, {"a": 0.9, "rare0": 0.1}])
def test_every_window_meets_its_targets(spark, library, targets):
    """Window by window: each live queue is served its share, within a token of what it is owed and another as a run's tokens are whole, until it runs dry; then the others share its part."""
    rows, window = corpus(6, 200), 128
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    pieces = packing.pack(docs, window=window, targets=targets).collect()
    check_pieces(rows, pieces, library, window, keyed=False)
    left, served = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        left[p["source"]] += p["length"]
        served[p["sequence_id"]][p["source"]] += p["length"]
    at, phases = 0, 0
    while True:
        live = {s for s in targets if left[s]}
        while live:
            quantum = {s: window * targets[s] / sum(targets[x] for x in live) for s in live}
            short = {s for s in live if left[s] < quantum[s]}
            if not short:
                break
            live -= short
        if not live:
            break
        windows = int(min(left[s] / quantum[s] for s in live))
        done = defaultdict(int)
        for r in range(1, windows + 1):
            own = served[at]
            assert own.keys() <= live and sum(own.values()) == window
            for s, n in own.items():
                done[s] += n
            assert all(abs(done[s] - r * quantum[s]) < 2 for s in live)
            at += 1
        for s, n in done.items():
            left[s] -= n
        phases += 1
    assert phases >= 1 and at > 3
    # what no target wants, and remainders below a window's part, follow
    assert sum(left.values()) == sum(n for q, own in served.items() if q >= at for n in own.values())


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(p["start"], p["length"], p["doc_tokens"], p["sequence_id"], p["offset"]) for p in one] == [(0, 1, 1, 0, 0)]


def test_schedules_serve_every_queue_whole():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.choice([0, 1, 3, 50, 1000, 20_000]) for _ in range(rng.randrange(1, 7))]
        shares = rng.choice([None, [rng.random() for _ in lengths], [0.0, *[1.0] * (len(lengths) - 1)]])
        if not sum(lengths):
            continue
        phases = packing.schedule(lengths, shares, 64)
        served = [sum(p.before[q + 1] - p.before[q] for p in phases) for q in range(len(lengths))]
        assert served == lengths
        used = defaultdict(list)
        for q, n in enumerate(lengths):
            ends = [p.begin[q] + p.before[q + 1] - p.before[q] for p in phases]
            at = 0
            for start in range(0, n, 37):
                for s, k, window, offset in packing.pieces(phases, ends, q, start, min(37, n - start), 64):
                    assert start + s == at
                    at += k
                    used[window].append((offset, k))
        for found in used.values():
            at = 0
            for offset, k in sorted(found):
                assert offset == at
                at += k
            assert at <= 64


def test_token_files(spark, library):
    rows = [(d, t) for d, t, _ in corpus(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = common.new_path(spark, "tokens")
    manifest, dictionary = token_file.write(docs, folder)
    got = token_file.read(manifest, dictionary).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [d for d, _ in order]
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        own = np.array(ids[r["doc_id"]], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    # one document by itself
    shard = manifest.orderBy("shard").first()
    content = open(dictionary.removeprefix("file://"), "rb").read()
    reader = token_file.Reader(shard["path"], content)
    doc_id, *_ = reader.entry(2)
    assert reader.ids(2).tolist() == ids[doc_id]
    with pytest.raises(ValueError, match="another dictionary"):
        token_file.Reader(shard["path"], content + b"x")
    assert glob.glob(folder.removeprefix("file://") + "/*.zdict")


def test_token_files_of_nothing(spark):
    assert token_file.round_trip(spark.createDataFrame([], "doc_id long, text string"), spark).count() == 0


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_tree(spark):
    import hashlib

    rng = random.Random(9)
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\n", "<\\|", "a\nb", "", "<", "<<|", "|>", "hello", "wörld"]
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, ["user", "assistant", "sys\ntem"][t % 3] if rng.random() < 0.9 else "tool", rng.choice(nasty[:4] if t < 2 else nasty)))
    rows += [(100, 0, None, None), (None, 0, "user", "x"), (101, None, "user", "y"), (101, 0, "assistant", "z"), (101, 0, "assistant", "z")]
    nodes, convs = chat_tree.tree(spark.createDataFrame(rows, CHAT))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_back(nodes, convs).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    expected = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        whole = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        size = sum(len("".join(chat_tree.format_turn(x[2], x[3]))) for x in turns)
        expected[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    assert got == expected
    # every shared beginning once, in depth-first order, with positions and ancestors of its path
    found = {r["node"]: r for r in nodes.collect()}
    prefixes = {tuple((x[2], x[3]) for x in turns[: i + 1]) for turns in by.values() for i in range(len(turns))}
    assert len(found) == len(prefixes)
    placed = sorted(found.values(), key=lambda r: r["offset"])
    at, path = 0, []
    for r in placed:
        assert r["offset"] == at
        at += r["tokens"]
        path = path[: r["depth"]]
        assert (path[-1] if path else None) == r["parent"]
        spans = [(found[p]["offset"], found[p]["offset"] + found[p]["tokens"]) for p in path]
        assert r["position"] == sum(b - a for a, b in spans)
        covered = [i for a, b in spans for i in range(a, b)]
        assert [i for a, b in r["ancestors"] for i in range(a, b)] == covered
        path.append(r["node"])


def test_chat_tree_of_nothing(spark):
    assert chat_tree.read_back(*chat_tree.tree(spark.createDataFrame([], CHAT))).count() == 0


def test_ids_do_not_depend_on_how_much_is_remembered(library):
    own = texts(3)
    expected = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in own]
    for remember in (0, 7, None):
        e = tokens.encoder(tokens.default_vocabulary(), remember)
        for _ in range(2):
            assert e.encode(own) == expected
        assert remember is None or len(e.after.new) <= remember // 2


def test_a_word_is_learned_once_whatever_signs_follow(library):
    rng, e = random.Random(23), tokens.PieceEncoder(tokens.default_vocabulary())
    words = ["".join(rng.choice("abcdeéÄßž") for _ in range(rng.randrange(3, 9))) for _ in range(200)]
    own = [" ".join(w + rng.choice(["", ".", ",", "&&&", ").", ".\nThe", "-"]) for w in rng.sample(words, 100)) for _ in range(60)]
    for t, got in zip(own, e.encode(own), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    # each with and without a blank in front, and the signs
    assert len(e.after.new) + len(e.plain.new) <= 2 * len(words) + 20


def test_odd_neighbours_of_letters_and_signs(library):
    """Every character below U+0180 and some beyond beside letters, signs and white space."""
    e = tokens.PieceEncoder(tokens.default_vocabulary())
    for c in [chr(x) for x in range(0x180)] + ["ſ", "ƀ", "\u0301", "а", "漢", "🙂", "’", "\u2028"]:
        own = [f"a{c}b", f"a {c}b", f"{c}", f" {c}", f"{c} ", f"é{c}.", f".{c}é", f".{c}.", f"a.\n{c}a", f"a\n\n{c}a", f"'{c}s", f"{c}'s", f"x {c}{c} ({c}) y"]
        for t, got in zip(own, e.encode(own), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pieces_are_matches_of_the_pattern(library):
    e = tokens.PieceEncoder(tokens.default_vocabulary())
    own = ["", "Thorlyou&&& aned.\nTherly, it's  éçaux ", *texts(5)]
    raw = [t.encode() for t in own]
    at = np.cumsum([0, *map(len, raw)])
    starts, match = e._cuts(own, np.frombuffer(b"".join(raw), np.uint8), at)
    pieces = [b"".join(raw)[x:y].decode() for x, y in zip(starts, [*starts[1:], at[-1]], strict=True)]
    assert [p for p in pieces[: np.searchsorted(starts, at[2])] if p.strip()] == ["Thorlyou", "&&&", " aned", ".", "Therly", ",", " it's", "  éçaux"]
    for p, m in zip(pieces, match, strict=True):
        assert not m or len(library.pre_tokenizer.pre_tokenize_str(p)) == 1


def test_a_vocabulary_with_a_normalizer_is_not_cut_into_matches(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokens.default_vocabulary(), encoding="utf-8") as f:
        plan = json.load(f) | {"normalizer": {"type": "Lowercase"}}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(plan), encoding="utf-8")
    e, own = tokens.PieceEncoder(str(path)), "The House, THE house. Été"
    assert np.frombuffer(e.encode([own])[0], "<u2").tolist() == Tokenizer.from_file(str(path)).encode(own, add_special_tokens=False).ids
    assert not e.after.new


def signed(seed, n):
    """Texts of few words under many signs."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéÄßž") for _ in range(rng.randrange(3, 9))) for _ in range(100)]
    return [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "&&&", ").", ".\nThe", "'s", "×"]) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_a_batch_for_packing_learns_few_pieces_without_memory():
    e, learned = tokens.PieceEncoder(tokens.default_vocabulary(), 0), []
    for memory in (e.after, e.plain):
        memory.encode = lambda pieces, encode=memory.encode: learned.extend(pieces) or encode(pieces)
    e.encode(signed(29, 512))
    # a word with and without a blank in front, alone or with 's or ×, and the signs
    assert len(learned) <= 6 * 100 + 30


def test_packing_of_signed_words_covers_the_librarys_ids(spark, library):
    own = [*signed(31, 60), None, "", "«x» 'tis\xa0so", "<|endoftext|>."]
    docs = spark.createDataFrame([(i, t, "s" + str(i % 3)) for i, t in enumerate(own)], "doc_id long, text string, source string")
    for r in packing.pack(docs).collect():
        ids = [*library.encode(own[r["doc_id"]] or "", add_special_tokens=False).ids, packing.END_ID]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
