"""The queries once more as plain SQL over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

REVIEWS = """reviews as (select event_id as review_id, user_id,
  cast(json_extract_string(props, '$.k') as bigint) as game_id,
  least(value / 10.0, 10.0) as rating, ts, event_type from events)"""
ORDERED = """ordered as (select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as review_id, o_custkey as user_id, l_partkey as game_id,
  l_quantity / 5.0 as rating, l_shipdate as ts from lineitem join orders on l_orderkey = o_orderkey)"""
GAMES = """games as (select p_partkey as game_id, p_name as title, string_split(p_name, ' ') as genres,
  p_type as platform, p_brand as developer, cast(p_size as double) as hours,
  (p_retailprice - 900) / 100 as critic, cast(1970 + p_size as int) as release_year from part)"""
KNOWN = "known as (select * from games where platform <> 'PROMO')"
FEED_A = """feed_a as (select c_name as author, l_quantity / 5.0 as score, p_name as game_name,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as date
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey)"""
FEED_B = f"""{REVIEWS}, feed_b as (select 'user' || user_id as author, floor(rating) as score, p_name as game_name,
  strftime(ts, '%Y-%m') as date, event_type as type, p_type as platform
  from reviews join part on game_id = p_partkey)"""


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence, row by row."""
    return f"""list_reduce(list_prepend([0 for i in range(len({b}) + 1)],
      [[ord(s)] for s in string_split({a}, '')]),
      lambda old, c: list_reduce(list_prepend([0],
        [[greatest(old[j + 1], old[j] + case when ord(substr({b}, j, 1)) = c[1] then 1 else 0 end)]
         for j in range(1, len({b}) + 1)]),
        lambda acc, e: list_append(acc, greatest(acc[-1], e[1]))))[-1]"""


def percent(a: str, b: str) -> str:
    return f"cast(round_even(200.0 * {common(a, b)} / (len({a}) + len({b})), 0) as int)"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- review corpus ---------------------------------------------------------

add("review_project_dropna", """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax from lineitem
  where l_returnflag = 'R' and nullif(l_discount, 0) is not null and nullif(l_tax, 0) is not null""")
add("review_union", f"""with {FEED_A}, {FEED_B}
  select author, score, game_name, date, cast(null as varchar) as type, cast(null as varchar) as platform from feed_a
  union all select distinct author, score, game_name, date, type, platform from feed_b""")
add("review_duplicates", f"""with {FEED_B} select cast(count(*) - (select count(*) from (select distinct * from feed_b))
  as bigint) as duplicate_rows from feed_b""")
add("duplicate_sample", f"""with {FEED_B} select author, score, game_name, date, type, platform,
  count(*) - 1 as extra_copies from feed_b group by all having count(*) > 1
  order by author, score, game_name, date, type, platform limit 5""")
add("review_concat_lists", f"with {REVIEWS} select distinct 'user' || user_id as author from reviews where rating > 5 or rating < 1")
add("profile_pages", f"""with {REVIEWS} select 'user' || user_id as author, rating as score,
  cast(game_id as varchar) as game_name, cast(review_id as varchar) as date, 'game-title' as type,
  event_type as platform from reviews
  where user_id in (select user_id from reviews group by 1 having count(*) >= 3)""")
add("page_completeness", f"""with {REVIEWS} select 'user' || user_id as author, count(*) as total_results,
  count(*) filter (where event_type <> 'view') as landed from reviews group by user_id
  having count(*) filter (where event_type = 'view') > 0""")
add("active_users", f"with {ORDERED} select user_id, count(*) as total_results from ordered group by 1 having count(*) >= 3")
add("active_user_reviews", f"""with {ORDERED} select review_id, user_id, game_id from ordered
  where user_id in (select user_id from ordered group by 1 having count(*) >= 3)""")
add("first_seen_author", f"""with {REVIEWS} select user_id, review_id, game_id, event_type from reviews
  qualify row_number() over (partition by user_id order by review_id) = 1""")
add("rating_mean", f"with {REVIEWS} select user_id, game_id, round(avg(rating), 9) as rating from reviews group by all")
add("rating_max", f"with {ORDERED} select user_id, game_id, max(rating) as rating from ordered group by all")
add("one_review_per_game", f"""with {REVIEWS} select user_id, game_id, review_id, rating from reviews
  qualify row_number() over (partition by user_id, game_id order by rating desc, ts desc, review_id desc) = 1""")
add("game_scores", f"""with {ORDERED}, s as (select game_id, count(rating) as n_reviews, avg(rating) as u from ordered group by 1),
  b as (select min(u) as lo, max(u) as hi from s)
  select game_id, n_reviews, round(u, 9) as user_score, round((u - lo) / (hi - lo), 9) as unit_score from s, b""")

# --- titles and matching ---------------------------------------------------

TITLES = "titles as (select distinct p_name || ' ' || p_brand as game_name from part)"
add("title_ids", f"with {TITLES} select row_number() over (order by game_name) - 1 as id, game_name from titles")
add("titles_from_offset", f"""with {TITLES}, n as (select row_number() over (order by game_name) - 1 as id, game_name
  from titles) select id, game_name from n where id >= 100""")
add("more_titles", f"""with {TITLES}, s as (select row_number() over (order by game_name) - 1 as id, game_name from titles
  where game_name >= 'h'), n as (select (select count(*) from s) + row_number() over (order by game_name) - 1 as id, game_name
  from titles where game_name < 'h') select * from s union all select * from n""")
add("resume_pending", f"""with {TITLES} select game_name from titles where game_name not in
  (select p_name || ' ' || p_brand from part where p_type = 'ECONOMY')""")
add("title_ratio", f"""with p as (select p_partkey, p_name || ' ' || p_partkey as a,
  p_type || ' ' || p_brand || ' ' || translate(p_name, 'io', '10') as b from part)
  select p_partkey, {percent('a', 'b')} as percent from p""")
add("normalised_titles", f"""with p as (select p_partkey,
  regexp_replace(p_name, '[^a-z ]', '', 'g') || ' 4 ' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || 's '
    || lower(p_type) as title,
  list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') as a,
  list_aggregate(list_sort(list_reverse(string_split(p_name, ' '))), 'string_agg', ' ') as b from part)
  select p_partkey, title, list_aggregate(list_sort(string_split(title, ' ')), 'string_agg', ' ') as sorted_title,
  {percent('a', 'b')} as percent from p""")
add("release_close", """with r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderdate, l_shipdate, l_quantity
  from lineitem join orders on l_orderkey = o_orderkey)
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') as order_day,
  case when l_quantity > 5 then strftime(l_shipdate, '%Y-%m-%d') else '' end as ship_day,
  l_quantity > 5 and abs(year(o_orderdate) - year(l_shipdate)) <= 1 as close,
  case when l_quantity > 20 then cast(cast(l_quantity + 1900 as int) as varchar) || '-01-01' else '' end as year_day from r""")

# The five answers per title, what was accepted of them, and the anchor.
ANSWERS = f"""a as (select *, p_name || ' ' || p_partkey as q, string_split(p_name, ' ')[1] as w1,
    string_split(p_name, ' ')[2] as w2 from part),
  b as (select *, case when p_size <= 5 then 'unrelated hit 0123456789' else upper(left(q, 1)) || substr(q, 2) end as g_name,
    q || ' ' || p_type as r_name, q as i_name, translate(q, 'io', '10') as h_name, q || ' ' || p_brand as m_name,
    p_size + 1990 as g_year, p_size + 1990 + case when p_type = 'LARGE' then 2 else 1 end as r_year,
    case when p_size > 20 then p_size + 1900 end as h_year, p_size + 1991 as m_year from a),
  c as (select *, {percent('g_name', 'q')} > 65 as g_ok, {percent('r_name', 'q')} as r_pct,
    {percent('h_name', 'q')} as h_pct, {percent('m_name', 'q')} as m_pct from b),
  d as (select *, r_pct > 90 or (r_pct > 65 and g_ok and abs(r_year - g_year) <= 1) as r_ok,
    h_pct > 90 or (h_pct > 65 and g_ok and coalesce(abs(h_year - g_year) <= 1, false)) as h_ok,
    p_type <> 'MEDIUM' and (m_pct > 90 or (m_pct > 65 and g_ok and abs(m_year - g_year) <= 1)) as m_ok from c)"""
add("accepted_hits", f"""with {ANSWERS} select q as game_name,
  case when g_ok then g_year || '-03-01' else '' end as anchor_release,
  case when g_ok then g_name else '' end as gamespot_name, case when r_ok then r_name else '' end as rawg_name,
  i_name as igdb_name, case when h_ok then h_name else '' end as hltb_name,
  case when m_ok then m_name else '' end as metacritic_name from d""")
add("golden_record", f"""with {ANSWERS}, e as (select *, p_type = 'SMALL' as small from d),
  f as (select row_number() over (order by q) - 1 as id, q as game_name,
  case when g_ok then g_name when r_ok then r_name else i_name end as name,
  case when g_ok then g_year || '-03-01' else '' end as release,
  case when h_ok then p_size * 1.0 when r_ok then p_size * 1.0 else 0.0 end as main_story,
  case when h_ok then p_size * 1.5 else 0.0 end as main_extra,
  case when h_ok then p_size * 2.0 else 0.0 end as completionist,
  case when g_ok and not small then 'deck ' || q when r_ok then 'about ' || q else 'sum ' || q end as description,
  round(case when r_ok then p_size / 10.0 / 5 else 0.0 end, 9) as rawg_rating,
  round(case when p_size > 10 then p_size * 2.0 / 100 else 0.0 end, 9) as igdb_rating,
  round(case when h_ok then p_size * 2.0 / 100 else 0.0 end, 9) as hltb_rating,
  round(case when m_ok and not small then p_size * 2 / 100.0 when r_ok then p_size * 2 / 100.0 else 0.0 end, 9) as metacritic_rating,
  round(case when m_ok then p_size / 5.0 / 10 else 0.0 end, 9) as user_rating,
  case when p_type <> 'LARGE' then [p_type, 'PC'] when r_ok or h_ok then [p_type] when m_ok then ['Console'] else [] end as platforms,
  [case when not small then 'i/' || p_partkey end] || case when g_ok then ['g/' || p_partkey] else [] end as cover_url,
  case when m_ok then ['dev ' || p_brand] when r_ok then [p_brand] else [] end as developers,
  case when m_ok then ['pub ' || p_type] when r_ok then ['pub ' || p_brand] else [] end as publishers,
  ['English'] as language_supports,
  case when r_ok then [w1] else [] end || [w1] || case when g_ok then [w1, w2] else [] end
    || case when m_ok then [p_type] else [] end as genres,
  case when r_ok then [p_brand, 'tagged'] else [] end || case when p_type <> 'MEDIUM' then [p_brand] else [] end || [w2]
    || ['Single player'] || ['Side view'] || [case when r_ok and not small then 'Teen' else '' end]
    || case when g_ok then [p_brand] else [] end as keywords from e)
  select id, game_name, name, release, cast(main_story as double) as main_story, cast(main_extra as double) as main_extra,
  cast(completionist as double) as completionist, description, cast(rawg_rating as double) as rawg_rating,
  cast(igdb_rating as double) as igdb_rating, cast(hltb_rating as double) as hltb_rating,
  cast(metacritic_rating as double) as metacritic_rating, cast(user_rating as double) as user_rating,
  array_to_string(platforms, '|') as platforms, coalesce(array_to_string(cover_url, '|'), '') as cover_url,
  array_to_string(developers, '|') as developers, array_to_string(publishers, '|') as publishers,
  array_to_string(language_supports, '|') as language_supports, array_to_string(genres, '|') as genres,
  array_to_string(keywords, '|') as keywords, cast(len(keywords) as int) as n_keywords, cast(len(cover_url) as int) as n_covers from f""")

add("best_slug", "select p_name || ' ' || p_partkey as query_name, 's-' || p_partkey as slug from part")


def record(extras: str = "", **fields: str) -> str:
    """A normalised record: the named fields, all others unknown."""
    texts = ("name", "release", "description")
    lists = ("platforms", "cover_url", "developers", "publishers", "language_supports", "genres", "keywords")
    numbers = ("rawg_rating", "igdb_rating", "hltb_rating", "metacritic_rating", "user_rating", "main_story", "main_extra", "completionist")
    out = ["p_name || ' ' || p_partkey as query_name", f"cast({fields.get('pos', '0')} as int) as pos",
           f"cast({fields.get('id', '0')} as bigint) as id"]
    out += [f"{fields.get(n, chr(39) * 2)} as {n}" for n in (*texts, *lists)]
    out += [f"round(cast({fields.get(n, '0')} as double), 9) as {n}" for n in numbers]
    out.append(f"cast({fields.get('n_covers', '0')} as int) as n_covers")
    return "select " + ", ".join(out) + (", " + extras if extras else "") + " from part"


Q = "p_name || ' ' || p_partkey"
W1, W2 = "string_split(p_name, ' ')[1]", "string_split(p_name, ' ')[2]"
add("rawg_records", record(
    "case when p_type <> 'SMALL' then 'Teen' else '' end as esrb_rating",
    id="p_partkey", name=f"{Q} || ' ' || p_type",
    release="(p_size + 1990 + case when p_type = 'LARGE' then 2 else 1 end) || '-01-15'",
    description=f"'about ' || {Q}", platforms="p_type", developers="p_brand", publishers="'pub ' || p_brand",
    genres=W1, keywords="p_brand || '|tagged'", rawg_rating="p_size / 10.0 / 5",
    metacritic_rating="p_size * 2 / 100.0", main_story="p_size"))
add("igdb_records", record(
    f"'Main Game' as game_type, 'Single player' as game_modes, 'Side view' as player_perspectives, {W2} as themes",
    id="p_partkey", name=Q,
    release="case when p_type <> 'PROMO' then strftime(date '1970-01-01' + cast(p_partkey * 10 as int), '%Y-%m-%d') else '' end",
    description=f"'sum ' || {Q}", platforms="case when p_type <> 'LARGE' then p_type || '|PC' else '' end",
    cover_url="case when p_type <> 'SMALL' then 'i/' || p_partkey else '' end", n_covers="1",
    language_supports="'English'", genres=W1, keywords="case when p_type <> 'MEDIUM' then p_brand else '' end",
    igdb_rating="case when p_size > 10 then p_size * 2.0 / 100 else 0 end"))
_HLTB = {
    "release": "case when p_size > 20 then (p_size + 1900) || '-01-01' else '' end", "platforms": "p_type",
    "hltb_rating": "p_size * 2.0 / 100", "main_story": "p_size", "main_extra": "p_size * 1.5", "completionist": "p_size * 2",
}
add("hltb_records", record("'game' as game_type", name=f"translate({Q}, 'io', '10')", **_HLTB) + " union all "
    + record("'game' as game_type", pos="1", name="'something else'", **_HLTB))
add("metacritic_records", record(
    name=f"{Q} || ' ' || p_brand", release="(p_size + 1991) || '-06-01'", platforms="'Console'",
    developers="'dev ' || p_brand", publishers="'pub ' || p_type", genres="p_type",
    metacritic_rating="case when p_type <> 'SMALL' then p_size * 2 / 100.0 else 0 end", user_rating="p_size / 5.0 / 10",
) + " where p_type <> 'MEDIUM'")
_XML = {
    "id": "p_partkey", "release": "(p_size + 1990) || '-03-01'",
    "name": f"case when p_size <= 5 then 'unrelated hit 0123456789' else upper(left(p_name, 1)) || substr({Q}, 2) end",
    "genres": f"{W1} || '|' || {W2}", "cover_url": "'g/' || p_partkey", "n_covers": "1",
    "description": f"case when p_type <> 'SMALL' then 'deck ' || {Q} end",
}
add("xml_game_records", record("p_brand as themes", **_XML))
add("xml_game_scan", f"""select p_partkey as id, {Q} as name, (p_size + 1990) || '-03-01' as release,
  case when p_type <> 'SMALL' then 'deck' end as description, {W1} || '|' || {W2} as genres, p_brand as themes from part""")

# The common length again, with the places of each character of one text as bits of a whole number.
def masked(text: str) -> str:
    """Per code from 32 to 126 the places of that character."""
    return f"""[list_sum([case when ord(substr({text}, i, 1)) = c then 1::hugeint << (i - 1)::int else 0::hugeint end
      for i in range(1, len({text}) + 1)])::hugeint for c in range(32, 127)]"""


def codes(text: str) -> str:
    return f"[ord(substr({text}, i, 1)) - 31 for i in range(1, len({text}) + 1)]"


def bit_percent(places: str, size: str, letters: str) -> str:
    """The score of a text with these places and size, and one with these letters."""
    ones = f"((1::hugeint << ({size})::int) - 1)"
    left = f"""bit_count(list_reduce(list_prepend({ones}, list_select({places}, {letters})),
      lambda r, h: ((r + (r & h)) | (r & ~h)) & {ones}))"""
    return f"cast(round_even(200.0 * ({size} - {left}) / ({size} + len({letters})), 0) as int)"


CATALOGUE = f"""catalogue as (select p_partkey as entry_id, case when p_size <= 10 then {Q}
    when p_size <= 20 then array_to_string([upper(left(w, 1)) || substr(w, 2) for w in string_split({Q}, ' ')], ' ')
    when p_size <= 30 then translate({Q}, 'io', '10') else 'the ' || {Q} end as name,
    (p_size + 1980) || '-05-05' as release, p_size + 1980 as year from part),
  entries as (select name, release, year, min(entry_id) as entry_id from catalogue group by all),
  titles as (select {Q} as game_name, p_size + 1980 as title_year from part),
  tb as (select *, {masked('game_name')} as places from titles),
  nb as (select name, {codes('name')} as letters from (select distinct name from catalogue)),
  scored as (select game_name, title_year, name, {bit_percent('places', 'len(game_name)', 'letters')} as percent from tb, nb),
  matched as (select game_name, entry_id, name, release, percent from scored join entries using (name)
    where percent > 90 or (percent > 65 and abs(year - title_year) <= 1))"""
add("catalogue_matches", f"with {CATALOGUE} select game_name, entry_id, name, release, percent from matched")
add("catalogue_best_match", f"""with {CATALOGUE} select game_name, entry_id, name, release, percent from matched
  qualify row_number() over (partition by game_name order by percent desc, entry_id) = 1""")
add("anchor_catalogue_match", f"""with {CATALOGUE} select game_name, entry_id, name, release, percent
  from scored join entries using (name) where percent > 65
  qualify row_number() over (partition by game_name order by percent desc, entry_id) = 1""")
add("tiered_match", f"""with l as (select distinct p_size + 1980 as year,
    array_to_string(list_sort(string_split({Q}, ' ')), ' ') as left_text, lower(p_type) as left_developer from part),
  r as (select distinct p_size + 1980 as year, array_to_string(list_sort(list_filter(
    [{W2}, {W1}, cast(p_partkey as varchar), case when p_size > 25 then '' else '2' end], lambda w: w <> '')), ' ') as right_text,
    lower(p_type) as right_developer from part),
  lb as (select *, {masked('left_text')} as places from (select distinct year, left_text from l)),
  rb as (select *, {codes('right_text')} as letters from (select distinct year, right_text from r)),
  ts as (select year, left_text, right_text, {bit_percent('places', 'len(left_text)', 'letters')} as percent from lb join rb using (year)),
  devs as (select distinct l.left_developer, r.right_developer from (select distinct left_developer from l) l, (select distinct right_developer from r) r),
  ds as (select *, {percent('left_developer', 'right_developer')} as developer_percent from devs)
  select year, left_text, right_text, percent, left_developer, right_developer, developer_percent,
  case when percent > 90 then 'title' else 'developer' end as tier
  from l join r using (year) join ts using (year, left_text, right_text) join ds using (left_developer, right_developer)
  where percent > 90 or (percent >= 70 and developer_percent > 90)""")

add("game_entities", f"""with recursive entries as (
    select p_partkey * 2 as entry_id, p_size + 1980 as year, array_to_string(list_sort(string_split({Q}, ' ')), ' ') as text,
      lower(p_type) as developer from part
    union all select p_partkey * 2 + 1, p_size + 1980, array_to_string(list_sort(list_filter(
      [{W2}, {W1}, cast(p_partkey as varchar), case when p_size > 25 then '' else '2' end], lambda w: w <> '')), ' '), lower(p_type) from part),
  texts as (select *, {masked('text')} as places, {codes('text')} as letters from (select distinct year, text from entries)),
  ts as (select a.year, a.text as left_text, b.text as right_text, {bit_percent('a.places', 'len(a.text)', 'b.letters')} as percent
    from texts a join texts b on a.year = b.year),
  devs as (select distinct developer from entries),
  ds as (select a.developer as left_developer, b.developer as right_developer, {percent('a.developer', 'b.developer')} as developer_percent
    from devs a, devs b),
  links as (select distinct a.entry_id as a, b.entry_id as b from ts join entries a on a.year = ts.year and a.text = ts.left_text
    join entries b on b.year = ts.year and b.text = ts.right_text
    join ds on ds.left_developer = a.developer and ds.right_developer = b.developer
    where percent > 90 or (percent >= 70 and developer_percent > 90)),
  reached as (select entry_id, entry_id as other from entries union select r.entry_id, l.b from reached r join links l on l.a = r.other),
  roots as (select entry_id, min(other) as entity_id from reached group by 1)
  select entry_id, entity_id, count(*) over (partition by entity_id) as entity_size from roots""")

# --- features --------------------------------------------------------------

add("genre_vocab", f"with {GAMES} select label, count(*) as n from (select unnest(genres) as label from games) group by 1")
VOCAB = "vocab as (select dim, row_number() over (order by dim) - 1 as place from (select distinct unnest(genres) as dim from {0}))"
add("genre_multihot", f"""with {GAMES}, {VOCAB.format('games')} select game_id, cast(place as int) as dim,
  case when list_contains(genres, v.dim) then 1.0::double else 0.0::double end as value from games, vocab v""")
add("genre_multihot_rows", f"with {GAMES} select distinct game_id, unnest(genres) as label from games")
add("platform_onehot", f"""with {GAMES}, top as (select platform, row_number() over (order by count(*) desc, platform) - 1 as place
  from games group by 1 qualify place < 10) select game_id, cast(place as int) as dim,
  case when games.platform = top.platform then 1.0::double else 0.0::double end as value from games, top""")
add("playtime_tanh", f"with {GAMES} select game_id, round(tanh(hours / 50), 9) as main from games")
add("minmax_scaled", f"""with {GAMES}, b as (select min(critic) as c0, max(critic) as c1, min(release_year) as y0,
  max(release_year) as y1 from games) select game_id, round((critic - c0) / (c1 - c0), 9) as unit_critic,
  round((release_year - y0) / (y1 - y0), 9) as unit_year from games, b""")
add("rewards", f"""with {REVIEWS}, {GAMES}, {KNOWN} select review_id, round((rating - 5) / 5, 9) as reward,
  cast(sign(rating - 5) as double) as ternary,
  round((rating - 5) / 5 + case when rating > 5 then 0.5 * tanh(rating * 10 / hours) else 0 end, 9) as with_bonus
  from reviews join known using (game_id)""")
RATED = "rated as (select user_id, game_id, avg(rating) as rating from reviews group by all)"
add("item_svd", f"""with {REVIEWS}, {RATED} select game_id, p_name as title, round(sum(rating * rating), 4) as squares
  from rated join part on game_id = p_partkey group by all""")
add("item_factor_shape", f"""with {REVIEWS} select count(distinct game_id) as games,
  cast(least(count(distinct game_id), count(distinct user_id), 32) as int) as width,
  cast(least(count(distinct game_id), count(distinct user_id), 32) as double) as squares,
  true as falling from reviews""")
add("embedding_table", f"""with {REVIEWS} select p_partkey as game_id, p_name as title,
  cast((select least(count(distinct game_id), count(distinct user_id), 32) from reviews) as int) as width
  from part where p_partkey in (select game_id from reviews)""")
add("description_word2vec", r"""select doc_id, 128 as width, cast(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as int) as n_words,
  cast(1 as bigint) as vectors, false as has_nan from documents""")
add("title_item2vec", f"with {REVIEWS} select distinct game_id, 128 as width, false as has_nan from reviews")
add("feature_vector", f"with {GAMES} select game_id, 324 as width, false as has_nan from games")
COMPANY = f"""{REVIEWS}, t as (select user_id, cast(game_id as varchar) as word,
    row_number() over (partition by user_id order by ts, review_id) - 1 as i from reviews),
  contexts as (select word as context from t group by 1 order by count(*) desc, 1 limit 1024),
  company as (select a.word, b.word as context, count(*)::bigint as times from t a join t b on a.user_id = b.user_id
    and a.i <> b.i and abs(a.i - b.i) <= 5 and a.i // 1000 = b.i // 1000 where b.word in (select context from contexts) group by all),
  cells as (select word, context, ln(times::double * (select sum(times)::double from company)
    / (sum(times) over (partition by word)::double * sum(times) over (partition by context)::double)) as value from company)"""
add("title_company", f"with {COMPANY} select word, context, times from company")
add("title_information", f"with {COMPANY} select word, context, round(value, 6) as value from cells where value > 0")
add("title_factors", f"""with {COMPANY} select (select count(*) from contexts)::int as contexts, true as solved, true as orthonormal,
  round(sum(value * value), 3) as squares from cells where value > 0""")
add("word_company", r"""with d as (select row_number() over () as row, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as l from documents),
  t as (select row, unnest(range(len(l))) as i, unnest(l) as word from d),
  contexts as (select word from t group by 1 order by count(*) desc, 1 limit 1024),
  near as (select b.word as context, a.word from t b join t a on a.row = b.row and a.i between b.i - 5 and b.i + 5 and a.i <> b.i
    where b.word in (select word from contexts))
  select context, count(distinct word) as words, count(*)::bigint as times from near group by 1""")
add("play_sentences", f"""with {REVIEWS} select user_id, cast(0 as bigint) as part,
  string_agg(cast(game_id as varchar), '|' order by ts, review_id) as games from reviews group by 1""")
add("feature_vector_fixed_parts", f"""with {REVIEWS}, {GAMES},
  top as (select dim, row_number() over (order by count(*) desc, dim) - 1 as place
    from (select unnest(genres) as dim from games) group by 1 qualify place < 20),
  tp as (select platform, row_number() over (order by count(*) desc, platform) - 1 as place from games group by 1 qualify place < 10),
  s as (select game_id, avg(rating) as u from reviews group by 1),
  gs as (select games.*, u from games left join s using (game_id)),
  b as (select min(u) as u0, max(u) as u1, min(critic) as c0, max(critic) as c1, min(release_year) as y0, max(release_year) as y1 from gs),
  cells as (
    select game_id, 20 as dim, (release_year - y0) / (y1 - y0) as value from gs, b
    union all select game_id, 31, tanh(hours / 50) from gs union all select game_id, 32, tanh(hours * 1.5 / 50) from gs
    union all select game_id, 33, tanh(hours * 2 / 50) from gs
    union all select game_id, 34, (critic - c0) / (c1 - c0) from gs, b
    union all select game_id, 35, coalesce((u - u0) / (u1 - u0), 0) from gs, b
    union all select game_id, place, 1.0 from gs, top where list_contains(genres, dim)
    union all select game_id, 21 + place, 1.0 from gs join tp using (platform)),
  frame as (select game_id, dim from games, (select unnest(range(36)) as dim))
  select game_id, cast(dim as int) as dim, round(coalesce(cast(value as double), 0.0), 9) as value
  from frame left join cells using (game_id, dim)""")

# --- transitions -----------------------------------------------------------

STEPS = f"""{REVIEWS}, {GAMES}, {KNOWN},
  t as (select *, case when row_number() over (partition by user_id order by ts desc, review_id desc) = 1 then 1 else 0 end
    as terminal from reviews),
  k as (select t.*, row_number() over (partition by user_id order by ts, review_id) as step, genres
    from t join known using (game_id))"""
add("mdp_transitions", f"""with {STEPS}, {VOCAB.format('known')},
  x as (select k.*, v.dim, case when list_contains(genres, v.dim) then 1.0 else 0.0 end as act from k, vocab v)
  select user_id, cast(step as int) as step, review_id, dim,
  coalesce(round(cast(sum(act) over w as double) / (step - 1), 5), 0.0) as obs, cast(act as double) as action,
  round((rating - 5) / 5, 5) as reward, terminal
  from x window w as (partition by user_id, dim order by step rows between unbounded preceding and 1 preceding)""")
add("mdp_repeated_games", f"""with {STEPS} select user_id, cast(step as int) as step, review_id,
  cast(len(list_distinct(genres)) as int) as genres, terminal from k""")
add("mdp_wide", f"""with {REVIEWS}, {GAMES}, {KNOWN},
  t as (select *, case when row_number() over (partition by user_id order by ts desc, review_id desc) = 1 then 1 else 0 end
    as terminal from reviews),
  k as (select t.*, 324 * 325 / 2 + 324 * hours as cell, row_number() over (partition by user_id order by ts, review_id) as step
    from t join known using (game_id))
  select user_id, cast(step as int) as step, review_id,
  cast(coalesce(sum(cell) over (partition by user_id order by step rows between unbounded preceding and 1 preceding), 0)
    as bigint) as earlier_sum, 324 as width, terminal from k""")
add("mdp_last_kept", f"""with {REVIEWS}, {GAMES}, {KNOWN}, o as (select * from reviews
    qualify row_number() over (partition by user_id, game_id order by rating desc, ts desc, review_id desc) = 1)
  select user_id, cast(row_number() over (partition by user_id order by ts, review_id) as int) as step, review_id,
  case when row_number() over (partition by user_id order by ts desc, review_id desc) = 1 then 1 else 0 end as terminal
  from o join known using (game_id)""")
add("mdp_untimed", f"""with {REVIEWS}, {GAMES}, {KNOWN}, t as (select *, case when row_number() over
    (partition by user_id order by review_id desc) = 1 then 1 else 0 end as terminal from reviews)
  select user_id, cast(row_number() over (partition by user_id order by review_id) as int) as step, review_id, terminal
  from t join known using (game_id)""")
add("mdp_shape", f"""with {ORDERED}, {GAMES}, {KNOWN}, t as (select *, row_number() over (partition by user_id
    order by ts desc, review_id desc) as back from ordered)
  select count(*) as transitions, count(distinct user_id) as users, cast(sum(case when back = 1 then 1 else 0 end) as bigint) as terminals,
  cast((select count(*) from (select distinct unnest(genres) from known)) as int) as observation_width,
  cast((select count(*) from (select distinct unnest(genres) from known)) as int) as action_width
  from t join known using (game_id)""")
add("mdp_written", f"""with {STEPS} select user_id, count(*) as steps, cast(max(step) as int) as last_step,
  cast(sum(terminal) as bigint) as terminals from k group by 1""")

# --- evaluation and recommendation -----------------------------------------

LOGGED = f"""{ORDERED}, {GAMES}, {KNOWN}, logged as (select ordered.*, hours, critic, (rating - 5) / 5 as reward
  from ordered join known using (game_id))"""
add("reward_model", f"""with {LOGGED} select round(regr_slope(reward, hours), 6) as slope,
  round(regr_intercept(reward, hours), 6) as intercept from logged""")
add("reward_model_states", f"""with {STEPS} select round(avg((rating - 5) / 5), 4) as direct_value,
  true as least_squares from k""")
POLICY = "policy as (select game_id, critic / (select sum(critic) from known) as probability from known)"
OUTCOMES = "outcomes as (select game_id, count(*) as n, sum(reward) as r, avg(reward) as m from logged group by 1)"
add("ips_value", f"""with {LOGGED}, {POLICY}, {OUTCOMES}, w as (select n, r, coalesce(probability, 0) /
  (n / (select sum(n) from outcomes)) as w from outcomes left join policy using (game_id))
  select round(sum(w * r) / sum(n), 6) as ips_value, round(sum(w * r) / sum(w * n), 6) as snips_value from w""")
add("direct_value", f"""with {LOGGED}, {POLICY}, {OUTCOMES} select round(sum(probability * m), 6) as direct_value
  from outcomes join policy using (game_id)""")
add("state_policies", f"""with {REVIEWS}, {GAMES}, {KNOWN}, {POLICY},
  k as (select user_id, ts, review_id, (rating - 5) / 5 as reward, case when platform = 'LARGE' then 1 else 0 end as a
    from reviews join known using (game_id)),
  steps as (select a, reward, coalesce(max(a) over (partition by user_id order by ts, review_id
    rows between unbounded preceding and 1 preceding), 0) as s from k),
  m as (select s, max(avg(reward)) over (partition by s) as best, a, avg(reward) as m from steps group by s, a),
  p as (select sum(probability) filter (where platform = 'LARGE') as share from policy join known using (game_id)),
  c as (select s, any_value(best) as best, sum(m * case when a = 1 then share else 1 - share end) as mean from m, p group by s)
  select 'greedy' as policy, round(avg(best), 5) as direct_value from steps join c using (s)
  union all select 'critics', round(avg(mean), 5) from steps join c using (s)""")
add("logged_policy", f"""with {LOGGED} select game_id, round(count(*) / (select count(*) from logged), 9) as probability
  from logged group by 1""")
add("action_scaling", f"""with {GAMES}, {KNOWN}, {VOCAB.format('known')} select game_id, cast(place as int) as dim,
  case when list_contains(genres, v.dim) then 1.0::double else -1.0::double end as value from known, vocab v""")
add("candidates_topk", """with s as (select a.vec_id as query_id, b.vec_id as item_id,
    round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
    from embeddings a, embeddings b where a.vec_id <> b.vec_id)
  select query_id, cast(row_number() over (partition by query_id order by score desc, item_id) as int) as rank, item_id, score
  from s qualify rank <= 5""")
MEANS = """means as (select user_id, dim, place, avg(case when list_contains(genres, dim) then 1.0 else 0.0 end) as value
    from chosen join known using (game_id), vocab group by all)"""
add("cold_start", f"""with {REVIEWS}, {GAMES}, {KNOWN}, {VOCAB.format('known')},
  chosen as (select user_id, game_id from reviews where event_type = 'signup'), {MEANS}
  select user_id, cast(place as int) as dim, round(value, 9) as value from means""")
add("top_recommendations", f"""with {REVIEWS}, {GAMES}, {KNOWN}, {VOCAB.format('known')},
  chosen as (select user_id, game_id from reviews where rating > 5), {MEANS},
  s as (select user_id, game_id, sum(value) as score from (select game_id, unnest(genres) as dim from known)
    join means using (dim) group by all),
  u as (select s.user_id, s.game_id, round(score, 6) as score from s left join
    (select distinct user_id, game_id, 1 as hit from reviews) p using (user_id, game_id) where hit is null)
  select user_id as query_id, cast(row_number() over (partition by user_id order by score desc, game_id) as int) as rank,
  game_id as item_id, score from u qualify rank <= 5""")
add("recommendation_filters", f"""with {GAMES} select game_id, release_year from games where release_year >= 2000
  and platform in ('LARGE', 'SMALL') and list_has_any(genres, ['blue', 'hot']) and developer = 'Brand#2'
  and game_id % 2 = 0""")
add("unplayed_games", f"""with {REVIEWS}, {ORDERED} select distinct user_id, game_id from ordered
  except select user_id, game_id from reviews""")

# --- sources and sinks -----------------------------------------------------

add("csv_round_trip", """select p_partkey as id, p_name || ', "' || p_type || '"' as name,
  case when p_type <> 'SMALL' then cast(p_size as double) end as size, 3 as n_tags,
  p_brand || '|it''s ' || p_name as tags from part""")
add("parquet_append", f"""with {FEED_A}, {FEED_B}, both_feeds as (select author, score, game_name, date from feed_a
  union all select author, score, game_name, date from feed_b)
  select game_name, count(*) as n, round(sum(score), 4) as score from both_feeds group by 1""")
add("xml_review_scan", f"""with {FEED_A} select author as authors, case when score >= 1 then score else 0.0 end as score,
  game_name, date as publish_date from feed_a""")
add("latest_payloads", """select cast(l_partkey as varchar) as query_name,
  l_orderkey || '-' || l_linenumber || '-' || l_suppkey as payload from lineitem
  qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc) = 1""")

# --- incremental -----------------------------------------------------------

add("stream_dedupe", "select event_id, user_id, event_type, value from events")
add("stream_append", "select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1")
add("feedback_upsert", """select user_id, cast(json_extract_string(props, '$.k') as bigint) as game_id, event_id, value from events
  qualify row_number() over (partition by user_id, json_extract_string(props, '$.k') order by event_id desc) = 1""")
