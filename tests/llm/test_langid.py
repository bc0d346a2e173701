import numpy as np

from tessera.llm import langid

DATA = "/root/testdata/sf0.01"


def test_code_lengths_equal_a_plain_walk_and_chances_sum_to_one():
    rows = [("x", "abra cadabra abra"), ("x", "abracad"), ("y", "xyzzy zyxxy über"), ("y", "zzz yyy")]
    model = langid.fit(rows)
    chances = 2.0 ** -model.bits.reshape(-1, model.size, 2)
    assert np.allclose(chances[1:].sum(axis=1), 1, atol=1e-4)
    batch = ["abra zyx", "", "über 12 cada", "z" * 3000]
    got = langid.code_lengths(model, batch)
    for text, bits in zip(batch, got, strict=True):
        stream = [int(model.symbol[b]) for b in (b"   " + text.encode()).translate(langid._FOLD)]
        want = np.zeros(2)
        for i in range(3, len(stream)):
            a, b, c = stream[i - 3 : i]
            want += model.bits[model.row[(a * model.size + b) * model.size + c] * model.size + stream[i]]
        assert np.allclose(bits, want, rtol=1e-4)


def plain_chance(streams, alphabet, used, context, symbol):
    """Chance of a symbol after a context of one language, by counting in its text: the longest context first, escape
    by method C, symbols seen in longer contexts excluded, at last a uniform byte."""
    excluded, chance = set(), 1.0
    for k in range(len(context), -1, -1):
        tail = context[len(context) - k :]
        if tail not in used[k]:
            continue
        counts = {}
        for stream in streams:
            for i in range(3, len(stream)):
                if stream[i - k : i] == tail:
                    counts[stream[i]] = counts.get(stream[i], 0) + 1
        total, distinct = sum(counts.values()), len(counts)
        if not total:
            continue
        if symbol in counts:
            return chance * counts[symbol] / (total + distinct) / shares(streams, alphabet, used, context, k, excluded)
        chance *= distinct / (total + distinct) / shares(streams, alphabet, used, context, k, excluded)
        excluded |= set(counts)
    return chance / 256 / max(1 - sum(1 for a in alphabet if a in excluded) / 256 - (256 - len(alphabet)) / 256, 1e-9)


def shares(streams, alphabet, used, context, k, excluded):
    """What the context of k symbols leaves to symbols that no longer one has seen."""
    if not excluded:
        return 1.0
    return sum(plain_chance(streams, alphabet, used, context[len(context) - k :], a) for a in alphabet if a not in excluded)


def test_code_lengths_equal_counting_escaping_and_excluding():
    rows = [("x", "abba abba abba cab"), ("y", "bc cb bc")]
    model = langid.fit(rows)
    folded = {name: [b"   " + t.encode().translate(langid._FOLD) + b"   " for lang, t in rows if lang == name] for name in model.languages}
    every = [s for streams in folded.values() for s in streams]
    alphabet = [-1, *sorted({b for s in every for b in s} | {0x20})]  # -1: a byte that no language has seen
    used = []
    for k in range(4):
        found = [s[i - k : i] for s in every for i in range(3, len(s))]
        used.append({c for c in found if found.count(c) >= (langid.LEAST_SEEN if k > 1 else 1)})
    for text in ("abba", "cab cc", "bcz", "zz abb"):
        got = langid.code_lengths(model, [text])[0]
        known = bytes(text, "ascii").translate(langid._FOLD)
        for j, name in enumerate(model.languages):
            want, stream = 0.0, b"   " + known
            for i in range(3, len(stream)):
                symbol = stream[i] if stream[i] in alphabet else -1
                want -= np.log2(plain_chance(folded[name], alphabet, used, stream[i - 3 : i], symbol))
            assert abs(got[j] - want) < 1e-2 * max(1, want), (text, name, got[j], want)


def test_windows_do_not_change_lengths(monkeypatch):
    model = langid.fit([("x", "some words of one kind " * 9), ("y", "autre sorte de mots " * 9)])
    batch = ["words of one kind", "", "autre", "x", "sorte de " * 20]
    whole = langid.code_lengths(model, batch)
    monkeypatch.setattr(langid, "_WINDOW", 7)
    assert np.allclose(whole, langid.code_lengths(model, batch), rtol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit_model(docs)
    held = docs.where(langid.crc_fold("doc_id", 4) == 2).join(langid.identify(docs, model), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (3, "123 !?"), (4, "the thing " * 50_000), (5, "日本語")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == "en" and got[5].lang_pred in model.languages and 0 <= got[5].score <= 1
    assert langid.identify(odd.limit(0), model).collect() == []


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit_model(docs)).first().lang_pred == "und"


def test_a_repeated_id_takes_one_place_of_the_sample(spark):
    rows = [(i, f"text {i}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = langid.training_rows(docs, "doc_id", "text", "lang", 20)
    assert len(first) == 20
    again = int(first[0][1].split()[1])
    repeated = docs.union(spark.createDataFrame([rows[again]] * 200, docs.schema))
    assert langid.training_rows(repeated, "doc_id", "text", "lang", 20) == first


def test_sample_stays_within_its_bytes(spark):
    rows = [(i, "x" * (100 + i), "en") for i in range(40)] + [(i, "y" * (100 + i), "de") for i in range(40, 80)] + [(80, "z" * 10_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.training_rows(docs, "doc_id", "text", "lang", 100)
    kept = langid.training_rows(docs, "doc_id", "text", "lang", 100, 1000)
    assert {lang for lang, _ in kept} == {"en", "de"} and set(kept) < set(whole)
    for lang in ("en", "de"):
        assert 500 < sum(len(t) for found, t in kept if found == lang) <= 1000  # the first by hash of the id that fit
    long = spark.createDataFrame([(1, "z" * 5000, "fr"), (2, "y" * 6000, "fr")], docs.schema)
    assert len([t for lang, t in langid.training_rows(docs.union(long), "doc_id", "text", "lang", 100, 1000) if lang == "fr"]) == 1  # one at least
    assert langid.training_rows(docs, "doc_id", "text", "lang", 100, 1_000_000) == whole
