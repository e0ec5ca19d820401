"""Whole licence texts, wrapped and unwrapped, and brute force over all runs of lines."""

import re
import textwrap

from termweave.llm import licences

WHOLE = {}
for _name, _text in licences.TEXTS:
    WHOLE[_name] = max(WHOLE.get(_name, ""), _text, key=len)


def grams(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return set(w) if len(w) < 2 else {f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)}


def brute(text):
    """The best run from each line of each template, without those that share lines with a better one."""
    lines, best = text.split("\n"), []
    words = [re.findall("[a-z0-9]+", x.lower()) for x in lines]
    after = [[w[0] for w in words[k + 1 :] if w][:1] for k in range(len(lines))]
    before = [[w[-1] for w in words[:k] if w][-1:] for k in range(len(lines))]
    for name, notice in sorted({*licences.TEMPLATES.items(), *licences.TEXTS}):
        t = grams(notice)
        for i in range(len(lines)):
            own = []
            for j in range(i, len(lines)):
                g = grams("\n".join(lines[i : j + 1]))
                if words[i] and words[j] and grams(" ".join(words[i] + after[i])) & t and grams(" ".join(before[j] + words[j])) & t and 2 * len(g & t) / (len(g) + len(t)) >= licences.THRESHOLD:
                    own.append((-round(2 * len(g & t) / (len(g) + len(t)) * len(g & t), 6), j - i, name, i, j, round(2 * len(g & t) / (len(g) + len(t)), 6)))
            best += [min(own)] if own else []
    return {(x[3], x[4], x[2], x[5]) for x in best if not any(y < x and y[3] <= x[4] and x[3] <= y[4] for y in best)}


def test_whole_texts_are_found_wrapped_and_unwrapped(spark):
    docs, want = [], set()
    for k, (name, notice) in enumerate(sorted(WHOLE.items())):
        for m, unit in enumerate((notice, textwrap.fill(notice, 76), textwrap.fill(notice, 50).replace("\n", "\n# "))):
            docs.append((10 * k + m, f"Some words before it.\n\n{unit}\n\nAnd a few others after it."))
            parts = unit.split("\n")  # a last line of bigrams that came before isn't needed
            last = next(j for j in range(len(parts)) if grams("\n".join(parts[: j + 1])) == grams(unit))
            want.add((10 * k + m, 2, 2 + last, name, 1.0))
    got = licences.scan_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_runs_equal_brute_force(spark):
    mit = textwrap.fill(WHOLE["MIT"], 70)
    texts = [None, "", "the fee\n" * 40, mit.replace("Software", "Program"), f"{mit}\nmy own words\n{mit}", f"{WHOLE['ISC']}\nLicensed under CC BY-NC 4.0.\n{licences.TEXTS[6][1]}", mit[:300], "hello\nlicensed under the apache license version 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in licences.scan_runs(docs).collect()}
    assert got == {(k, *x) for k, t in enumerate(texts) for x in brute(t or "")} and {r[0] for r in got} >= {4, 5, 7}


def test_every_template_is_told_from_every_other(spark):
    known = sorted({*licences.TEMPLATES.items(), *licences.TEXTS})
    docs = spark.createDataFrame([(k, f"{text}\nwords of the document that follow it") for k, (_, text) in enumerate(known)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).filter("unit = 'line'").collect()}
    for k, (name, _) in enumerate(known):
        assert got[k].licence == name and got[k].dice == 1.0, name
    grams = [set(licences_pairs(text)) for _, text in known]
    for i, (a, _) in enumerate(known):
        for j, (b, _) in enumerate(known):
            assert a == b or grams[i] != grams[j]


def licences_pairs(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return list(zip(w, w[1:], strict=False))


def test_notices_with_a_name_or_a_year_keep_their_licence(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. Copyright 2020 someone."
    told = [(gpl.format("GNU Lesser General Public License", 3), "LGPL-3.0"), (gpl.format("GNU Affero General Public License", 3), "AGPL-3.0"), (gpl.format("GNU General Public License", 2), "GPL-2.0"), ("It is licensed under the GNU General Public License, version 2.", "GPL-2.0")]
    told += [("The work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Work licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD")]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(told)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs).collect()}
    assert got == {k: name for k, (_, name) in enumerate(told)}
