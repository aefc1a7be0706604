"""Bodies of pages built from rows: HTML texts and blocks. The formats are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import acronym_markup, html_escape

#: Settings of a block, and those that a button has besides; all empty. Fixed values.
SETTINGS = ("custom_template", "custom_css_class", "custom_id")
BUTTON_SETTINGS = ("ga_tracking_event_category", "ga_tracking_event_label")


def settings(css_class: str = "", more: tuple[str, ...] = ()) -> Column:
    """Settings of a block with a class of its own."""
    return F.struct(*[F.lit(css_class if name == "custom_css_class" else "").alias(name) for name in (*SETTINGS, *more)])


def hero_html(name: Column, title: Column, meaning: Column) -> Column:
    """The head of the home page: its full name, its short title, and the words the title stands for."""
    reveal = 'home-reveal home-reveal--up" style="--reveal-delay:0ms"'
    return F.concat(
        F.lit(f'<div class="home-hero">\n  <p class="home-fullname {reveal}>'), name, F.lit(f'</p>\n  <h1 class="home-title {reveal}>'), title,
        F.lit(f'</h1>\n  <div class="home-title-divider {reveal} aria-hidden="true"></div>\n  <div class="home-acronym {reveal}>\n    <p class="home-eyebrow home-eyebrow--acronym">'),
        acronym_markup(meaning), F.lit("</p>\n  </div>\n</div>"),
    )


def principle_html(title: str, body: Column, cases: Column) -> Column:
    """A section whose cases, an array of (mark, body), are folded away."""
    return F.concat(
        F.lit(f'<div class="home-section">\n  <h2 class="home-section-title">{title}</h2>\n  <div class="home-cases-fold">\n    <p class="home-principle">'), body,
        F.lit('\n      <span class="home-cases-toggle" role="button" tabindex="0" aria-expanded="false">\n        <span class="home-cases-more" aria-hidden="true">&hellip;</span>\n      </span>\n    </p>\n    <div class="home-cases home-cases-body">\n'),
        cases_html(cases), F.lit("\n    </div>\n  </div>\n</div>"),
    )


def heading_html(title: str) -> str:
    """A section that is a heading only."""
    return f'<div class="home-section home-section--goals">\n  <h2 class="home-section-title">{title}</h2>\n</div>'


def goal_html(title: Column, paragraphs: Column) -> Column:
    """The body of a goal's page: its title and an array of paragraphs, escaped."""
    inner = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("    <p>"), html_escape(p), F.lit("</p>"))), "\n")
    return F.concat(
        F.lit('<div class="goal-detail">\n  <h1 class="goal-detail-title">'), html_escape(title),
        F.lit('</h1>\n  <div class="goal-detail-body">\n'), inner, F.lit("\n  </div>\n</div>"),
    )


def section_html(title: str, body: Column) -> Column:
    """A section of the home page; its body is markup already."""
    return F.concat(F.lit(f'<div class="home-section">\n  <h2 class="home-section-title">{title}</h2>\n  <p class="home-principle">'), body, F.lit("</p>\n</div>"))


def cases_html(cases: Column) -> Column:
    """An array of (mark, body) as paragraphs."""
    one = lambda c: F.concat(F.lit('    <p class="home-case"><span class="home-case-mark">'), c["mark"], F.lit("</span><br>\n    "), c["body"], F.lit("</p>"))
    return F.array_join(F.transform(cases, one), "\n")


def html_block(markup: Column) -> Column:
    return F.struct(F.lit("html").alias("type"), markup.alias("value"))


def card(number: Column, title: Column, abstract: Column, page: Column, label: Column) -> Column:
    """A card that links to a page."""
    link = F.struct(
        settings(more=BUTTON_SETTINGS).alias("settings"), page.alias("page_link"), F.lit(None).cast("bigint").alias("doc_link"), F.lit("").alias("other_link"),
        label.alias("button_title"), F.lit("btn-link").alias("button_style"), F.lit("").alias("button_size"),
    )
    text = F.concat(F.lit("<p>"), html_escape(abstract), F.lit("</p>"))
    return F.struct(settings("home-goal-card").alias("settings"), F.lit(None).cast("bigint").alias("image"), title.alias("title"), number.alias("subtitle"), text.alias("description"), F.array(link).alias("links"))


def card_grid(cards: Column) -> Column:
    """A block with an array of cards, as JSON."""
    return F.struct(F.lit("cardgrid").alias("type"), F.to_json(F.struct(settings("home-goals").alias("settings"), F.lit(True).alias("fluid"), cards.alias("content")), {"ignoreNullFields": "false"}).alias("value"))


def home_body(hero: Column, mission: Column, principle: Column, cards: Column, goals_title: str = "Goals") -> Column:
    """The blocks of a home page in their order."""
    return F.array(*[html_block(x) for x in (hero, mission, principle, F.lit(heading_html(goals_title)))], card_grid(cards))
