"""Field rules on small pages: stage order and quirks."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.config import DirectoryConfig
from siteroster.operators import contact
from siteroster.operators.filters import is_blocked, is_shop, relevance_score, shop_element_count
from siteroster.operators.company import company_name
from siteroster.operators.person import contact_person
from siteroster.operators.results import parse_result_pages
from siteroster.plans.contacts import contact_columns, extract_contacts, read_parsed
from siteroster.operators.html import parse_pages
from tests.test_html import pages

CONFIG = DirectoryConfig.sample(countries=("Guinea", "Guinea-Bissau", "Niger", "Nigeria", "Kenya"))


def run(spark, rule, *htmls):
    table = read_parsed(pages(spark, *htmls))
    return [r[0] for r in table.orderBy("page_id").select(rule).collect()]


def phones(spark, *htmls, patterns=tuple(fv.SAMPLE_PHONE_PATTERNS)):
    return run(spark, contact.phone(patterns, CONFIG.phone_prefixes), *htmls)


def test_email_first_acceptable_anywhere_in_the_source(spark):
    got = run(spark, contact.email(), "<a href='mailto:X@Y.org'>a@example.com</a>",
              "<img src='l@2x.png'> info@a.org sales@b.org", "none")
    assert got == ["x@y.org", "info@a.org", None]


def test_phone_lines_before_text(spark):
    cases = {
        "<p>0115550199 first</p>\n<p>Tel 0115550100</p>": "0115550100",
        "<p>hotel: 0115550123</p>": "0115550123",
        # the first pattern overshoots to 15 digits, the second starts one digit later
        "<p>1234567</p> <p>0115550100</p>": "+234 5670115",
        "<p>Call 7777777 or 0115550100</p>": "0115550100",
        "<p>Tel 123456789012345</p>": "1234567890",
        "<p>Tel +254 700 123 456</p>": "+254700123456",
        "<p>Tel 254 700 123 456</p>": "+254 700123456",
    }
    assert phones(spark, *cases) == list(cases.values())


def test_phone_second_pass_takes_only_the_first_hit(spark):
    assert phones(spark, "<p>7777777 ~ 8005550100</p>", patterns=(r"\b\d{7,15}\b",)) == [None]
    assert phones(spark, "<p>tel 7777777 ~ 8005550100</p>", patterns=(r"\b\d{7,15}\b",)) == ["8005550100"]


def test_phone_patterns_with_groups(spark):
    page = "<p>tel 0115550100</p>"
    assert phones(spark, page, patterns=(r"(\d{10})",)) == ["0115550100"]
    assert phones(spark, page, patterns=(r"(\d{3})(\d{7})", r"\d{10}")) == [None]
    assert phones(spark, page, patterns=(r"(x)(y)", r"\d{10}")) == ["0115550100"]
    assert phones(spark, page, patterns=()) == [None]


def test_country_order_and_boundaries(spark):
    rule = contact.country(CONFIG.countries, CONFIG.country_keywords)
    got = run(
        spark, rule,
        "<p>Kenya and Guinea</p>", "<p>guinea-bissau</p>", "<p>Nigeria</p>", "<p>aKenya</p>",
        "<div><p>Address: x</p> Kenya</div>tail", "<div><p>Address: x</p> Kenya</div>",
        "<section><div><span>based in</span> Kenya</div></section>s",
    )
    assert got == ["Guinea", "Guinea", "Nigeria", None, "Kenya", "Kenya", "Kenya"]


def test_city_stages(spark):
    got = run(
        spark, contact.city(),
        "<i itemprop=addressLocality content=''> Accra </i>",
        "<p class=capacity>12 beds</p><p class=city>Accra</p>",
        f"<p class=town>{'x' * 60}</p>",
        "<p>Town: accra, Village - Old Ibadan here</p>",
        "<p>Accra, Ghana</p>\n<p>x</p>\n<p>Tel: 1</p>",
        "<p>Accra, Ghana</p>\n<p>x</p>\n<p>y</p>\n<p>Tel: 1</p>",
        "<i itemprop=addressLocality content='  '></i><p>City: Accra</p>",
        "<p class=locality>Loc</p><p class=city>Cit</p>",
    )
    assert got == ["Accra", "12 beds", None, "Old Ibadan", "Accra", None, None, "Cit"]


def test_state_stages(spark):
    got = run(
        spark, contact.state(),
        "<p>Statement</p>", "<p>County: North Bank</p>", "<p class=Province>P</p>",
        '<script type="application/ld+json">{"location":{"addressRegion":"R"}}</script>',
        "<p>Accra, Ghana</p>\n<p>Tel: 1</p>",
    )
    assert got == [None, "North Bank", "P", "R", None]


def test_products_in_configured_order(spark):
    rule = contact.products(F.col("text"), ["pouch", "Gown", "gown", "pouch", "reel"])
    assert run(spark, rule, "<p>GOWNS and a po<b>uch</b></p>") == [["pouch", "Gown", "gown"]]


def test_company_name_order(spark):
    rule = company_name(F.col("url"), F.lit("The Title"))
    got = run(
        spark, rule,
        "<meta name='og:site_name' content='By Name'><meta property='og:site_name' content='By Prop'>",
        "<meta property='og:site_name' content='logo'><meta name='og:site_name' content='Unused'>",
        "<header><a href='/'>x</a><img alt='Head Img'></header><img class='my-logo' alt='Logo Img'>",
        "<header><a href='/'><img alt='Home Img'></a></header><a class='logo'><img alt='A'></a>",
        "<footer>© 2024 Acme & Sons, Ltd</footer>",
        "<footer>copyright Acme Trading 2020</footer>",
        "<p>nothing</p>",
    )
    assert got == ["By Prop", "The Title", "Logo Img", "Home Img", "Acme & Sons", "Acme Trading", "The Title"]


def test_company_name_falls_back_to_title_then_host(spark):
    table = parse_pages(pages(spark, "<p>x</p>").withColumn("url", F.lit("https://home.com/")))
    both = table.select(
        company_name(F.col("url"), F.lit("A Title")), company_name(F.col("url"), F.lit("cart"))
    ).first()
    assert tuple(both) == ("A Title", "Home")


def people(spark, *htmls):
    found = run(spark, contact_person(("Steam",)), *htmls)
    return [tuple(p) if p.name else None for p in found]


def test_person_stage_order(spark):
    got = people(
        spark,
        "<meta name=author content='Anna Berg'><p>jane.doe@x.org</p>",
        "<p>jane.doe@x.org, Eva Strand CEO</p>",
        "<p>x@x.org Eva Strand, CEO</p>\n<div class=team><h3>Olga Holm</h3><p>CEO</p></div>",
        "<p>Director: Eva Strand</p>\n<p>Contact us: Olga Holm</p>",
        "<p>Eva Strand (CEO)</p>",
        "<p>Manager</p>\n<p>Technician or Analyst: the Eva Strand</p>",
        "<p>Eva Strand</p>",
    )
    assert got == [
        ("Anna Berg", None), ("Jane Doe", None), ("Eva Strand", "CEO"), ("Olga Holm", None),
        ("Eva Strand", "CEO"), ("Eva Strand", "Technician"), None,
    ]


def test_person_from_jsonld(spark):
    block = '<script type="application/ld+json">{}</script>'.format
    got = people(
        spark,
        block('{"@type":"Person","name":"Eva Strand","jobTitle":"","description":"Buyer"}'),
        block('{"@type":"Person","name":"bad","founder":{"@type":"Person","name":"Eva Strand"}}'),
        block('{"@type":"Organization","founder":[],"employee":{"@type":"Person","name":"Eva Strand"}}'),
        block('{"@type":"Organization","founder":"x","employee":{"@type":"Person","name":"Eva Strand"}}'),
        block('{"@graph":[{"@type":"Person","name":"Eva Strand"}]}'),
        block('{"@type":"Person","name":"Eva Strand","jobTitle":"' + "x" * 60 + '"}'),
    )
    assert got == [("Eva Strand", "Buyer"), ("Eva Strand", None), ("Eva Strand", None), None, None, ("Eva Strand", None)]


def test_team_blocks(spark):
    got = people(
        spark,
        "<li class=staff><strong>Eva Strand</strong> — CEO</li>",
        "<div class=member><b>Eva Strand</b> — CEO<p>, bio</p></div>",
        "<div class=member><b>Eva Strand</b><div class=role-x>Owner</div><p>CEO</p></div>",
        "<table><tr><td>Steam Berg</td><td>CEO</td></tr><tr><td>Eva Strand</td><td>ceo</td></tr></table>",
        "<h2>Team</h2><p>Eva Strand</p><p>a</p><p>b</p><p>CEO</p>",
        "<h2>Team</h2><p>Eva Strand</p><p>a</p><p>b</p><p>c</p><p>CEO</p>",
        "<h3>Board</h3><p>Eva Strand</p><p>VP</p><h1>Our Team</h1>",
    )
    # the first page has no paragraph to hold a role, so only the line pattern finds it
    assert got == [
        ("Eva Strand", "CEO"), ("Eva Strand", "CEO"), ("Eva Strand", "Owner"), ("Eva Strand", "CEO"),
        ("Eva Strand", "CEO"), None, ("Eva Strand", "VP"),
    ]


def test_shop_and_relevance(spark):
    html = "<a>Cart</a><button>x <b>Cart</b></button><div><a>CHECKOUT</a></div><ul class='catalog'></ul><div class='catalogs'></div>"
    assert run(spark, shop_element_count(), html) == [4]
    assert run(spark, is_shop(F.col("text"), CONFIG.ecommerce_indicators), html) == [False]
    score = relevance_score(F.col("text"), ["sterile gown", "Sterile"])
    assert run(spark, score, "<p>STERILE GOWNS made in a factory</p>", "<p>x</p>") == [4, 0]


def test_blocked(spark):
    table = pages(spark, "I'm Not A Robot", "<div class='g-recaptcha'>", "fine")
    assert [r[0] for r in table.select(is_blocked(F.col("html"))).collect()] == [True, True, False]


def test_result_pages_last_url_first_place(spark):
    html = (
        "<div class='g'><a href='https://a.org'>A</a></div>"
        "<div class='g'><a>no address</a><a href='https://skip.org'>S</a></div>"
        "<div class='yuRUbf'><a href='https://b.org'><h3>B</h3></a></div>"
        "<div class='g'><a href='https://c.org'><h3>A</h3></a></div>"
        "<div class='g'><a href='https://www.google.com/x'>G</a></div>"
    )
    rows = parse_result_pages(parse_pages(pages(spark, html))).orderBy("pos").collect()
    assert [(r.title, r.url) for r in rows] == [("A", "https://c.org"), ("B", "https://b.org")]


def test_all_fields_agree_with_single_fields(spark):
    htmls = (
        "<p>Tel 0115550100 Kenya</p><p class=city>Accra</p> a@b.org <p>CEO: Eva Strand</p>",
        "<p>x</p>",
        "<meta property='og:site_name' content='Acme Ltd'><p>County: Bo</p>",
    )
    table = extract_contacts(pages(spark, *htmls), CONFIG)
    together = {r.page_id: r for r in table.collect()}
    for name, rule in contact_columns(CONFIG).items():
        for i, value in enumerate(run(spark, rule, *htmls)):
            if name == "person":
                assert together[i].contact_person == (value.name if value else None)
            else:
                assert together[i][name] == value
    assert together[0].position == "CEO"
    assert together[2].company_name == "Acme Ltd"


def test_extraction_is_one_narrow_pass(spark):
    table = extract_contacts(pages(spark, "<p>x</p>"), CONFIG)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("MapInArrow") == 1


def test_empty_configuration(spark):
    bare = dataclasses.replace(DirectoryConfig())
    row = extract_contacts(pages(spark, "<p>Tel 0115550100 Kenya</p>"), bare).first()
    assert (row.phone, row.country) == (None, None)
