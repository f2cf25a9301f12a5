"""SQL for DuckDB where an operator can be expressed in it."""

from __future__ import annotations

#: crc32 by its rule: each byte's remainder in eight steps, then one lookup for each byte of the text
_CRC = """
    xor(list_reduce(list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST('0x' || substr(hexed, 2 * i - 1, 2) AS BIGINT)),
      lambda crc, byte: xor(crc >> 8, remainders[(xor(crc, byte) & 255) + 1]), 4294967295), 4294967295)"""


def sharding(shards: int) -> str:
    """``op9_sharding`` with equal weights: the largest draw wins, as its cost is the least."""
    draw = "CAST('0x' || substr(md5('k' || doc_id || ':' || {}), 1, 13) AS BIGINT)"
    return f"""
    WITH steps AS (
      SELECT list_transform(range(256), lambda byte: list_reduce(range(8), lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, byte)) AS remainders),
    texts AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hexed FROM documents),
    sized AS (SELECT doc_id, octet_length(encode(text)) + 8 AS size, {_CRC} AS text_crc32 FROM texts, steps),
    draws AS (SELECT doc_id, shard, {draw.format("shard")} AS draw FROM documents, range({shards + 1}) AS r(shard)),
    chosen AS (
      SELECT doc_id, arg_max(shard, draw) FILTER (shard < {shards}) AS shard, arg_max(shard, draw) AS grown_shard FROM draws GROUP BY doc_id)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY {draw.format("'order'")}, doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
    FROM sized JOIN chosen USING (doc_id)"""


_REMAINDERS = "SELECT list_transform(range(256), lambda byte: list_reduce(range(8), lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, byte)) AS remainders"


def _crc(hexed: str) -> str:
    """The unsigned crc32 of the bytes that ``hexed`` writes; ``remainders`` must be in scope."""
    return f"""xor(list_reduce(list_transform(range(1, length({hexed}) // 2 + 1), lambda i: CAST('0x' || substr({hexed}, 2 * i - 1, 2) AS BIGINT)),
      lambda crc, byte: xor(crc >> 8, remainders[(xor(crc, byte) & 255) + 1]), 4294967295), 4294967295)"""


def conversations() -> str:
    """``op12_conversations``: the least (cost, audit) of each state, row by row.

    A state is a struct of ``way`` (cost in nine digits, then the audit) and ``said`` (the repaired rows so far).
    """

    def step(state: str, cost: str, letter: str, said: str = "") -> str:
        line = f"{state}.said" if not said else f"CASE WHEN {state}.said IS NULL THEN {said} ELSE {state}.said || chr(10) || {said} END"
        way = f"lpad(CAST(CAST(left({state}.way, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({state}.way, 10) || '{letter}'"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'way': {way}, 'said': {line}}} END"

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"

    def passed(state: str, initial: str, name: str, before: list[str]) -> str:
        deleted = step(state, "4", "D")
        stays = [deleted]
        for one in before:
            kept = step(one, "lost", "K", "role || ':' || text")
            stays.append(f"CASE WHEN sound AND left(role, 1) = '{initial}' THEN {kept} END")
            if name:
                stays.append(f"CASE WHEN sound THEN {step(one, '3 + lost', 'R', chr(39) + name + ':' + chr(39) + ' || text')} END")
        return least(*stays)

    added_user, added_assistant = "'user:'", "'assistant:'"
    user = least("p2", *(step(one, "3", "I", added_user) for one in ("p0", "p1", "p3")))
    assistant = least("p3", step("u2", "3", "I", added_assistant))
    return f"""
    WITH RECURSIVE steps AS ({_REMAINDERS}),
    hashed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS hexed FROM conversations),
    chosen AS (SELECT conv_id, turn, role, text, {_crc("hexed")} % 20 AS damage FROM hashed, steps),
    damaged AS (
      SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM chosen),
    numbered AS (
      SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM damaged),
    judged AS (
      SELECT conv_id, turn, role, text, i, blank, NOT blank AND said_before > 1 AS duplicate, NOT blank AND said_before = 1 AND cut AS truncated,
        NOT blank AND said_before = 1 AS sound, CASE WHEN cut THEN 3 ELSE 0 END AS lost,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS said_before FROM numbered)),
    counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
    begun AS (SELECT conv_id, {{'way': '000000000', 'said': CAST(NULL AS VARCHAR)}} AS p0 FROM counted),
    walk AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, p0 AS s0, CAST(NULL AS STRUCT(way VARCHAR, said VARCHAR)) AS s1, {step("p0", "3", "I", added_user)} AS s2,
        {step("p0", "6", "II", added_user + " || chr(10) || " + added_assistant)} AS s3 FROM begun
      UNION ALL
      SELECT conv_id, i, p0, p1, u2, {assistant} FROM (
        SELECT conv_id, i, p0, p1, p3, {user} AS u2 FROM (
          SELECT walk.conv_id, judged.i, {passed("s0", "", "", [])} AS p0, {passed("s1", "s", "", ["s0"])} AS p1,
            {passed("s2", "u", "user", ["s0", "s1", "s3"])} AS p2, {passed("s3", "a", "assistant", ["s2"])} AS p3
          FROM walk JOIN judged ON judged.conv_id IS NOT DISTINCT FROM walk.conv_id AND judged.i = walk.i + 1))),
    found AS (
      SELECT counted.*, {least("s0", "s3")} AS best FROM walk JOIN counted ON counted.conv_id IS NOT DISTINCT FROM walk.conv_id AND counted.n = walk.i)
    SELECT named.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(left(best.way, 9) AS INTEGER), 0) AS BIGINT) AS cost,
      coalesce(substr(best.way, 10), '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS named LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM named.conv_id"""


def spellings(letters: int) -> str:
    """``op13_spellings``: near words share what is left after one letter is taken out of both, or of the longer."""
    return f"""
    WITH RECURSIVE steps AS ({_REMAINDERS}),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
    counted AS (
      SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS times FROM runs
      WHERE length(run) >= {letters} GROUP BY ALL),
    hexed AS (SELECT low, times, hex(encode(doc || ':' || low)) AS code FROM counted),
    hashed AS (SELECT low, times, {_crc("code")} AS hash FROM hexed, steps),
    spelt AS (SELECT CASE WHEN hash % 31 = 0 THEN left(low, hash % length(low)) || substr(low, hash % length(low) + 2) ELSE low END AS word, times FROM hashed),
    words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= {letters} GROUP BY word HAVING sum(times) >= 2),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    rests AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
    pairs AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM rests AS a JOIN rests AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM rests AS a JOIN words AS b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM rests AS a JOIN words AS b ON a.rest = b.word),
    near AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
    best AS (SELECT word, n_near, most, min(other) AS other FROM near JOIN pairs USING (word) WHERE other_n = most GROUP BY ALL),
    formed AS (
      SELECT words.word, n, CASE WHEN most >= 10 * n THEN other END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n, coalesce(n_near, 0) AS n_near
      FROM words LEFT JOIN best USING (word)),
    chain AS (
      SELECT word, word AS root, 0 AS depth FROM formed
      UNION ALL SELECT chain.word, formed.form, depth + 1 FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
    SELECT word, n, form, form_n, root, n_near FROM formed JOIN roots USING (word)"""
