"""Evidence views: texts with personal data, derived from the given tables.

The SQL runs alike in Spark and DuckDB. Every row comes from a row of ``customer`` or ``orders``, so the
views grow with the data.
"""

from __future__ import annotations

from ..fixed import SUBSCRIBER_HEADER

FIRST_NAMES = (
    "Anna,Boris,Carla,Daniel,Elena,Fabio,Greta,Hugo,Irene,Jonas,Klara,Lukas,Marta,Nico,Olga,Pablo,Quentin,Rosa,"
    "Stefan,Tilda,Ugo,Vera,Wim,Xenia,Yara"
)
LAST_NAMES = (
    "Adler,Bakker,Claes,Dubois,Evers,Fischer,Garcia,Hansen,Ivanov,Janssen,Keller,Lambert,Mertens,Novak,Olsen,Peeters,"
    "Quist,Rossi,Schmidt,Torres,Urban,Vermeer,Weber"
)

_USER = "concat('cust.n', lpad(cast(c_custkey as varchar(20)), greatest(6, cast(length(cast(c_custkey as varchar(20))) as int)), '0'))"

VIEWS = {
    "ev_people": f"""
      select c_custkey as k, {_USER} as username,
        concat({_USER}, '@mail', cast(c_custkey % 5 as varchar(20)), '.example.com') as email,
        split_part('{FIRST_NAMES}', ',', cast(c_custkey % 25 as int) + 1) as first_name,
        split_part('{LAST_NAMES}', ',', cast(c_custkey % 23 as int) + 1) as last_name,
        case when c_custkey % 3 = 0 then concat('DESKTOP-CUST', lpad(cast(c_custkey as varchar(20)), greatest(6, cast(length(cast(c_custkey as varchar(20))) as int)), '0'))
             else concat('LAPTOP-Cust-', lpad(cast(c_custkey as varchar(20)), greatest(6, cast(length(cast(c_custkey as varchar(20))) as int)), '0')) end as host,
        concat('+1 (555) ', lpad(cast(cast(floor(c_custkey / 10000) as bigint) % 1000 as varchar(20)), 3, '0'), '-',
               lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) as phone,
        concat('BE', lpad(cast((98 - (c_custkey * 1000000 + 111400) % 97)
                 + (case when c_custkey % 7 = 0 then 1 else 0 end) as varchar(20)), 2, '0'),
               lpad(cast(c_custkey as varchar(20)), greatest(12, cast(length(cast(c_custkey as varchar(20))) as int)), '0')) as iban
      from customer""",
    "ev_accounts": """
      select k as doc_id, concat('Payee ', first_name, ' IBAN ',
        case when k % 2 = 0 then iban
             else concat(substr(iban, 1, 4), ' ', substr(iban, 5, 4), ' ', substr(iban, 9, 4), ' ', substr(iban, 13, 4))
        end, ' host ', host, ' ok') as text
      from ev_people""",
    "ev_log": """
      select o_orderkey as doc_id, concat(
        '2026-03-15 14:23:01 sshd[1234]: Accepted publickey for ', username, ' from 10.0.',
          cast(o_orderkey % 250 as varchar(20)), '.7 port 22 ssh2', chr(10),
        'app: File accessed: C:', chr(92), 'Users', chr(92), username, chr(92), 'Documents and /home/',
          username, '/notes and /home/root/x', chr(10),
        'app: password=Secret', cast(k as varchar(20)), '! for user admin_backup', chr(10),
        'app: Phone contact: ', phone, ' for user ', username, chr(10),
        'app: Device ', host, ' seen', chr(10),
        'app: mail to ', email, chr(10),
        'app: SHA256: ', md5(email), md5(phone), chr(10)) as text
      from orders join ev_people on o_custkey = k""",
    "ev_json": """
      select k as doc_id, concat(
        '{"display_name": "', first_name, ' ', last_name, '", "username": "', username,
        '", "home_address": "', last_name, ' street ', cast(k % 90 + 1 as varchar(20)),
        '", "phone_number": "', phone, '", "full_name": "unknown", "nick_name": "', cast(k as varchar(20)), '"}', chr(10),
        'login_name = ', username, chr(10), 'naam = "', first_name, '"', chr(10),
        'residence: ', chr(39), ' ', last_name, ' lane ', cast(k % 50 + 10 as varchar(20)), ' ', chr(39)) as text
      from ev_people""",
    "ev_social": """
      select k as doc_id, concat(
        'Follow @', replace(username, '.', '_'), ' or u/', replace(username, '.', '_'), ' here: https://',
        split_part('www.instagram.com/,x.com/,facebook.com/,tiktok.com/@,linkedin.com/in/,youtube.com/@,t.me/,snapchat.com/add/,www.reddit.com/user/',
                   ',', cast(k % 9 as int) + 1), 'p', cast(k as varchar(20)), 'zed', chr(10),
        'not https://instagram.com/stories/x, not @everyone, not @99', chr(10),
        '"twitter_username": "tw', cast(k as varchar(20)), 'q"', chr(10),
        'Tag ', 'dd', cast(k as varchar(20)), 'k#', lpad(cast(k % 10000 as varchar(20)), 4, '0'), ' end') as text
      from ev_people""",
    "ev_export": f"""
      select k as doc_id, concat(
        'Target username "', username, '"', chr(10),
        '{SUBSCRIBER_HEADER}', chr(10),
        username, ',', email, ',verified,,2026-01-01,10.0.0.1,', phone, ',sms,,,', first_name, ' ', last_name, ',active', chr(10),
        '2026-01-02 10:00:00 UTC,USERNAME,old.', cast(k as varchar(20)), ',', username, ',USER', chr(10),
        '2026-01-03 10:00:00 UTC,DISPLAY_NAME,', first_name, ',', first_name, ' ', last_name, ',USER', chr(10),
        'old.', cast(k as varchar(20)), ',', username, ',2026-01-02 10:00:00 UTC', chr(10)) as text
      from ev_people""",
    "ev_secrets": """
      select k as doc_id, concat('value "',
        case k % 8
          when 0 then concat('AKIA', upper(substr(md5(email), 1, 16)))
          when 1 then concat(upper(md5(email)), lower(substr(md5(host), 1, 8)))
          when 2 then concat('AIza', md5(email), upper(substr(md5(host), 1, 3)))
          when 3 then concat('sk_live_', md5(email))
          when 4 then concat(md5(email), substr(md5(host), 1, 8))
          when 5 then concat('ghp_', upper(md5(email)), substr(md5(host), 1, 8))
          when 6 then concat(cast(10000000 + k as varchar(20)), ':', md5(email), upper(substr(md5(host), 1, 3)))
          else concat(md5(email), upper(substr(md5(host), 1, 9))) end,
        '" call 04', lpad(cast(k % 100 as varchar(20)), 2, '0'), ' 12 34 56 or 555-', lpad(cast(k % 1000 as varchar(20)), 3, '0'), '-4567', chr(10),
        'operator = "', username, '"', chr(10), '10.0.0.1 - ', first_name, '.', last_name, ' [01/Jan]', chr(10),
        '{"caller_id": "', last_name, '_', cast(k as varchar(20)), '"}') as text
      from ev_people""",
    "ev_table": """
      select o_orderkey as row_id, concat('2026-03-01T08:', lpad(cast(o_orderkey % 60 as varchar(20)), 2, '0'), ':00Z') as Timestamp,
        email as UserPrincipalName, concat(first_name, ' ', last_name) as DisplayName,
        concat('10.1.', cast(o_orderkey % 250 as varchar(20)), '.9') as IPAddress, o_orderstatus as Status,
        host as DeviceName, o_totalprice as Amount
      from orders join ev_people on o_custkey = k""",
    "ev_allow": """
      select 'case-1' as case_id, username as value, 'username' as value_type, 'staff' as reason
        from ev_people where k in (select s_nationkey from supplier)
      union all
      select distinct 'case-1', concat('mail', cast(n_regionkey as varchar(20)), '.EXAMPLE.com'), 'domain', 'own domain'
        from nation where n_regionkey < 2
      union all
      select 'case-1', upper(concat('Secret', cast(k as varchar(20)), '!')), 'ioc', 'known'
        from ev_people where k in (select n_nationkey from nation)""",
    "ev_files": """
      select doc_id, concat(source, '/', lang, '/f', cast(doc_id as varchar(20)),
        split_part('.txt,.LOG,.csv,.tsv,.json,.bin,.docx,,.md', ',', cast(doc_id % 9 as int) + 1)) as path, text
      from documents""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it uses as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with"):
        return f"with {ctes},\n{body[len('with'):]}"
    return f"with {ctes}\n{body}"
