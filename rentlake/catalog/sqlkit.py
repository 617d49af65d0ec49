"""Small pieces of DuckDB SQL the oracles are put together from."""

from __future__ import annotations

from rentlake import fixed_values as V
from rentlake.functions.regex import SPACE, respell


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, fold_case: bool = True) -> str:
    """Pattern as a literal in RE2 spelling."""
    return q(("(?i)" if fold_case else "") + respell(pattern, SPACE, lambda *_: r"\b", "$"))


def has(x: str, *patterns: str, fold_case: bool = True) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"coalesce(regexp_matches({x}, {re2(joined, fold_case)}), false)"


def group(x: str, pattern: str, n: int = 1, fold_case: bool = True) -> str:
    return f"nullif(regexp_extract({x}, {re2(pattern, fold_case)}, {n}), '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def num(x: str) -> str:
    return f"(case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end)"


def half_up(x: str) -> str:
    return f"floor({x} + 0.5)"


def fold(x: str) -> str:
    return collapse(f"regexp_replace(strip_accents(lower({x})), '[.,]', ' ', 'g')")


def cut_before(src: str, out: str, patterns, beyond: int) -> list[dict]:
    """Steps that cut ``src`` at each marker in turn."""
    steps, now = [], src
    for i, pattern in enumerate(patterns):
        head, name = f"{out}_h{i}", out if i == len(patterns) - 1 else f"{out}_{i}"
        steps.append({head: f"string_split_regex({now}, {re2(pattern)})[1]"})
        steps.append({name: f"case when length({head}) > {beyond} then trim({head}) else {now} end"})
        now = name
    return steps


def amount(src: str, out: str) -> list[dict]:
    b, p, n = f"{out}_b", f"{out}_p", f"{out}_n"
    dots = f"replace({b}, '.', '')"
    return [
        {b: f"regexp_replace({src}, '[{SPACE}]', '', 'g')"},
        {p: f"""case
            when contains({b}, ',') and contains({b}, '.') and instr(reverse({b}), ',') < instr(reverse({b}), '.')
              then replace({dots}, ',', '.')
            when contains({b}, ',') and contains({b}, '.') then replace({b}, ',', '')
            when length({b}) - length(replace({b}, ',', '')) = 1 and length(split_part({b}, ',', 2)) = 3
              then replace({b}, ',', '')
            when contains({b}, ',') then replace({b}, ',', '.')
            when regexp_matches({b}, '^\\d{{1,3}}(\\.\\d{{3}})+$') then {dots}
            else {b} end"""},
        {n: f"floor(try_cast(nullif(regexp_extract({p}, '^\\d+(\\.\\d+)?'), '') as double) + 0.5)"},
        {out: f"case when {n} = 1 and regexp_matches({p}, '^1\\.0+$') then 1000 else {n} end"},
    ]


def accept(n: str, thousand: str, month: str) -> str:
    fixed = f"(case when {thousand} or {n} = 1 then 1000 else {n} end)"
    return f"(case when {fixed} between 150 and 15000 and ({fixed} <= 1500 or {month}) then {fixed} end)"


def rent(src: str, out: str) -> list[dict]:
    m, a, b, t = f"{out}_m", f"{out}_a", f"{out}_bf", f"{out}_t"
    steps = [{
        m: group(src, V.RENT_MONTHLY), a: group(src, V.RENT_AFTER_SIGN), b: group(src, V.RENT_BEFORE_SIGN),
        t: f"regexp_extract({src}, {re2(V.RENT_AFTER_SIGN_TAIL)}, 1)",
        f"{out}_k": has(src, V.RENT_THOUSAND), f"{out}_w": has(src, V.RENT_MONTH_WORD),
    }]
    for name in (m, a, b):
        steps += amount(name, f"{name}n")
    ok = {name: accept(f"{name}n", f"{out}_k", f"{out}_w") for name in (m, a, b)}
    steps.append({out: f"""cast(coalesce(
        case when {m} is not null then {ok[m]} end,
        case when {a} is not null and not {has(t, V.AREA_TAIL)} then {ok[a]} end,
        case when {b} is not null then {ok[b]} end) as integer)"""})
    return steps


def area(src: str) -> str:
    return f"try_cast({group(src, V.AREA)} as double)"


def rooms(src: str) -> str:
    return (
        f"coalesce(try_cast({group(src, V.ROOMS_EN)} as double), try_cast({group(src, V.ROOMS_STANZE)} as double), "
        f"try_cast(replace({group(src, V.ROOMS_LOCALI)}, ',', '.') as double))"
    )


def room_words(src: str) -> str:
    cases = " ".join(f"when {has(src, rf'\b{w}\b')} then {float(n)}" for w, n in V.ROOM_WORDS)
    return f"cast(case {cases} end as double)"


def fee(src: str) -> str:
    return f"try_cast({group(src, V.CONDO_FEE)} as integer)"


def host(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, '(?i)^\\s*https?://([^/?#:\\s<>|^@]+)', 1)), '')"


def bare_host(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def target(url: str) -> str:
    """Path and query."""
    return f"regexp_extract({url}, '(?i)^\\s*https?://[^/?#\\s]+([^#]*)', 1)"


def form(x: str) -> str:
    """Form encoding of a decoded text; DuckDB escapes by the stricter URI set."""
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def url_path(p: str) -> str:
    """Dot segments resolved (up to four times ``..``) and other characters escaped."""
    out = f"regexp_replace({p}, '/(\\./)+', '/', 'g')"
    for _ in range(4):
        out = f"regexp_replace({out}, '^((?:/[^/]+)*?)/?[^/]*/\\.\\.(/|$)', '\\1/')"
    kept = "!$&()*+,;=:@/[]|^%" + "'"
    out = f"url_encode({out})"
    for c in kept:
        out = f"replace({out}, '%{ord(c):02X}', {q(c)})"
    return out


def canonical(src: str, out: str) -> list[dict]:
    h, p, s, o = f"{out}_h", f"{out}_p", f"{out}_s", f"{out}_o"
    decoded = "url_decode(replace({}, '+', ' '))"
    pairs = (
        f"list_transform(list_filter(string_split(regexp_extract({src}, '\\?([^#]*)', 1), '&'), "
        f"lambda p: p <> '' and not list_contains([{', '.join(map(q, V.UTM_PARAMS))}], split_part(p, '=', 1))), "
        f"lambda p: {form(decoded.format(chr(39).join(['split_part(p, ', '=', ', 1)'])))} || '=' || {form(decoded.format(chr(39).join(['substr(p, length(split_part(p, ', '=', ', 1)) + 2)'])))})"
    )
    return [
        {h: host(src), p: f"regexp_extract({src}, '(?i)^\\s*https?://[^/?#\\s]+([^?#]*)', 1)",
         s: f"array_to_string({pairs}, '&')", o: f"regexp_extract({src}, '(?i)^\\s*https?://[^/?#:\\s]+(:\\d+)', 1)"},
        {out: f"""case when {h} is null then null
          when regexp_matches({h}, 'casa\\.it$') and regexp_matches({p}, '(?i)/immobili/\\d+')
            then 'https://www.casa.it/immobili/' || regexp_extract({p}, '(?i)/immobili/(\\d+)', 1) || '/'
          when regexp_matches({h}, 'casa\\.it$') and regexp_matches({p}, '(?i)/annunci/\\d+')
            then 'https://www.casa.it/annunci/' || regexp_extract({p}, '(?i)/annunci/(\\d+)', 1) || '/'
          else lower(regexp_extract({src}, '(?i)(https?)://', 1)) || '://' || {h}
            || case when {o} = ':443' and regexp_matches({src}, '(?i)^\\s*https:') or {o} = ':80' and regexp_matches({src}, '(?i)^\\s*http:') then '' else {o} end
            || case when {p} = '' then '/' else {url_path(p)} end
            || case when {s} = '' then '' else '?' || {s} end end"""},
    ]


def listing_page(url: str) -> str:
    h, t = bare_host(url), target(url)
    cases = " ".join(
        f"when ends_with({h}, {q(d)}) then regexp_matches({t}, {re2('|'.join(ps))})" for d, ps in V.LISTING_PATHS.items()
    )
    blocked = " or ".join(f"starts_with({h}, {q(p)})" for p in V.TRACKING_HOST_PREFIXES)
    return f"coalesce(case when {blocked} then false {cases} else false end, false)"


def last_two(h: str) -> str:
    parts = f"list_filter(string_split({h}, '.'), lambda p: p <> '')"
    return f"(case when len({parts}) >= 2 then array_to_string({parts}[-2:], '.') end)"


def base_domain(h: str) -> str:
    labels = "|".join(V.TRACKING_LABELS)
    return last_two(f"regexp_replace(regexp_replace(lower({h}), '\\.$', ''), '^(?:(?:{labels})\\.)+', '')")


def http_site(url: str) -> str:
    return f"(case when starts_with({url}, 'http') then {base_domain(host(url))} end)"


def source_key(source: str, listing: str, canon: str) -> str:
    return (
        f"coalesce({http_site(listing)}, {http_site(canon)}, "
        f"case when contains({source}, '.') then trim(lower(regexp_replace({source}, '^www\\.', ''))) end)"
    )


def portal_home(key: str, listing: str, canon: str) -> str:
    dotted = f"case when contains({key}, '.') then lower(regexp_replace({key}, '^www\\.', '')) end"
    return f"('https://www.' || coalesce({http_site(listing)}, {http_site(canon)}, {dotted}))"


def source_line(source: str, listing: str, canon: str) -> str:
    return f"""(case when {source} = 'facebook.group' then
        case when contains(coalesce({listing}, {canon}), 'facebook.com') then '📌 Facebook · ' || coalesce({listing}, {canon})
             else '📌 Facebook group' end
        else '📌 ' || {portal_home(source_key(source, listing, canon), listing, canon)} end)"""


def url_score(url: str) -> str:
    cases = " ".join(f"when regexp_matches({url}, {re2(p)}) then {n}" for p, n in V.URL_SCORES)
    return f"(case {cases} when starts_with({url}, 'http') then 5 else 0 end)"


def open_link(listing: str, canon: str) -> str:
    return f"""(case when starts_with({listing}, 'http') then {listing}
        when contains({canon}, '/annunci/alert-') then null when starts_with({canon}, 'http') then {canon} end)"""


def street(src: str) -> str:
    f = fold(src)
    return f"""(case when regexp_matches({f}, {re2(V.STREET)}) then 'via-' || regexp_extract({f}, {re2(V.STREET)}, 1)
        || case when regexp_extract({f}, {re2(V.STREET)}, 2) <> '' then '-' || regexp_extract({f}, {re2(V.STREET)}, 2) else '' end end)"""


def blob(*cols: str) -> str:
    return " || ' ' || ".join(f"coalesce({c}, '')" for c in cols)


def whole(x: str) -> str:
    return f"coalesce(cast(cast(floor({x} + 0.5) as bigint) as varchar), '?')"


def call_to_action(x: str) -> str:
    return f"(length({collapse(x)}) < 4 or {has(collapse(x), V.CALL_TO_ACTION)})"


def meaningful(x: str) -> str:
    t = collapse(f"coalesce({x}, '')")
    return f"(length({t}) >= 8 and not {has(t, r'^listing$')} and not {call_to_action(t)})"


def distance_text(m: str) -> str:
    return f"""(case when {m} < 1000 then '~' || cast(cast({half_up(m)} as bigint) as varchar) || ' m'
        when {m} % 1000 = 250 then '~' || cast(cast(floor({m} / 1000) as bigint) as varchar) || '.3 km'
        else '~' || printf('%.1f', {m} / 1000.0) || ' km' end)"""


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"""(2 * 6371000.0 * asin(least(1.0, sqrt(
        pow(sin(radians({lat2} - {lat1}) / 2), 2)
        + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"""


def all_of(*parts: str) -> str:
    return " and ".join(f"({p})" for p in parts)


def chain(with_: str, base: str, steps: list[dict], final: str) -> str:
    """``with`` views, then one CTE per step that adds its columns, then the final select."""
    ctes, prev = ([with_] if with_ else []), base
    for i, step in enumerate(steps):
        cols = ", ".join(f"{expr} as {name}" for name, expr in step.items())
        ctes.append(f"s{i} as (select *, {cols} from {prev})")
        prev = f"s{i}"
    head = "with " + ",\n".join(ctes) + "\n" if ctes else ""
    return head + final.replace("{from}", prev)
