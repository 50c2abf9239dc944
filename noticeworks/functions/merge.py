"""Two readings of a notice made one, what they disagree about, and a headline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract, numbers
from .describe import usable
from .text import case_of_capitals, clip, fold, once, sentence_case


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_headline(c: Column) -> Column:
    """A model's headline of 4 to 90 characters; none that echoes the official title."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"^[-\s–—:;,]+|[:;,\s]+\z", ""))
    return F.when((F.length(t) >= 4) & ~(t.rlike(r"(?iu)^zaklju[cč]ak\b") & (F.length(t) > 40)), F.substring(t, 1, 90))


def merged(*readings: Column | dict[str, Column]) -> Column:
    """``merged_fields`` as one struct."""
    return F.struct(*(c.alias(n) for n, c in merged_fields(*readings).items()))


def merged_fields(llm: Column, rules: dict[str, Column], rule_description: Column, rule_tags: Column, title: Column, body: Column) -> dict[str, Column]:
    """By field, the model's reading where it is sound, the rules' elsewhere; without a model, the rules' alone.

    ``llm`` is the struct of a landed reading (null without one), ``rules`` the fields of ``extract.with_reading``.
    """
    has = llm.isNotNull()
    money = numbers.reconcile(llm["appraisedValue"], llm["startingPrice"], llm["deposit"], rules["money"]["printed"], rules["money"]["appraised"], rules["money"]["starting"], rules["money"]["deposit"])
    described = F.when(has & usable(llm["itemDescription"]), F.substring(llm["itemDescription"], 1, 400)).otherwise(rule_description)
    own_tags = has & (F.size(llm["itemTags"]) > 0)
    known = lambda a, b: F.when(has & a.isNotNull() & (a != "nepoznato"), a).otherwise(b)
    record = F.when(has, extract.sanitised(F.coalesce(llm["cadastral"]["kc"], F.array().cast("array<string>")), F.coalesce(llm["cadastral"]["zkUlozak"], F.array().cast("array<string>")), F.coalesce(llm["cadastral"]["ko"], F.array().cast("array<string>"))))
    return {
        "headline": clean_headline(llm["headline"]), "item_description": described, "item_tags": F.when(own_tags, llm["itemTags"]).otherwise(rule_tags),
        "case_number": F.coalesce(rules["case_number"], F.trim(llm["caseNumber"])), "money": F.when(has, money).otherwise(F.struct(*(rules["money"][n].alias(n) for n in ("appraised", "starting", "deposit")))),
        "sale_time": F.when(llm["saleTime"].rlike(r"^\d{2}:\d{2}\z"), llm["saleTime"]).otherwise(rules["sale_time"]), "auction_round": known(llm["auctionRound"], rules["auction_round"]), "sale_method": known(llm["saleMethod"], rules["sale_method"]),
        "auction_location": F.coalesce(_filled(llm["auctionLocation"]), rules["auction_location"]), "municipality": F.coalesce(_filled(llm["municipality"]), rules["municipality"]), "cadastral": F.coalesce(record, rules["cadastral"]),
        "sale_type": F.when(own_tags, extract.infer_sale_type(F.concat_ws("\n", title, F.coalesce(described, F.substring(body, 1, 2000))))),
    }


def disagreements(llm: Column, rules: dict[str, Column]) -> Column:
    """An array of ``struct<field, llm, rules, ratio>``: amounts two per cent apart or more, case numbers and times that differ."""

    def amount(name: str, a: Column, b: Column) -> Column:
        ratio = F.try_divide(F.greatest(a, b), F.when(F.least(a, b) > 0, F.least(a, b)))
        return F.when(ratio - 1 > 0.02, F.struct(F.lit(name).alias("field"), a.cast("string").alias("llm"), b.cast("string").alias("rules"), numbers.js_round(ratio).alias("ratio")))

    def word(name: str, a: Column, b: Column) -> Column:
        norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
        return F.when(norm(a) != norm(b), F.struct(F.lit(name).alias("field"), a.alias("llm"), b.alias("rules"), F.lit(None).cast("double").alias("ratio")))

    m = rules["money"]
    return F.array_compact(
        F.array(
            amount("appraisedValue", llm["appraisedValue"], m["appraised"]), amount("startingPrice", llm["startingPrice"], m["starting"]), amount("deposit", llm["deposit"], m["deposit"]),
            word("caseNumber", llm["caseNumber"], rules["case_number"]), word("saleTime", llm["saleTime"], rules["sale_time"]),
        )
    )


_KINDS = (("poslovn\\w+\\s+prostor", "Poslovni prostor"), ("stamben\\w+\\s+(?:zgrad|objek)", "Stambeni objekat"), ("ku[cć][ae](?!\\w)", "Kuća"), ("stana?(?!\\w)", "Stan"), ("gara[zž]", "Garaža"), ("oranic", "Oranica"), ("njiv", "Njiva"), ("livad", "Livada"), ("gradili[sš]t", "Građevinsko zemljište"))
_BASES = {"nekretnine": "Nekretnina", "vozila": "Vozilo", "tehnika": "Tehnička oprema", "namjestaj": "Namještaj", "ostalo": "Pokretne stvari"}


def headline(own: Column, sale_type: Column, description: Column, title: Column, ko: Column, municipality: Column) -> Column:
    """A model's headline, else a property's kind, size and place, else the first things listed, else kind and place."""
    return once(F.concat_ws(" ", description, title), lambda text: _headline(text, own, sale_type, description, ko, municipality))


def _headline(text: Column, own: Column, sale_type: Column, description: Column, ko: Column, municipality: Column) -> Column:
    kind = None
    for pattern, label in _KINDS:
        hit = text.rlike(rf"(?iu)(?<![\p{{L}}]){pattern}")
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    area = F.nullif(F.regexp_extract(text, r"(?iu)povr[sš]ine(?:\s+od)?\s+(\d[.,\d]*)\s*m\s?[2²]", 1), F.lit(""))
    place = case_of_capitals(F.coalesce(F.regexp_replace(F.get(ko, 0), r"(?i)^SP[_\s]*", ""), municipality))
    property_ = F.when((sale_type == "nekretnine") & kind.isNotNull(), F.concat_ws(" - ", F.concat_ws(" ", kind, F.concat(area, F.lit(" m²"))), place))
    parts = F.transform(F.split(description, r";"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?iu)\s*[-–—,]?\s*(?:vrijednost\w*\s*)?[\d.,]+\s*KM.*\z", ""), r"[„“”\"']", "")))
    parts = F.filter(parts, lambda p: (F.length(p) >= 3) & p.rlike(r"(?iu)[a-zčćžšđ]{3,}"))
    shown = lambda p: F.concat(F.array_join(F.transform(F.slice(p, 1, 3), sentence_case), ", "), F.when(F.size(p) > 3, F.concat(F.lit(" i još "), (F.size(p) - 3).cast("string"))).otherwise(""))
    listed = once(once(parts, shown), lambda x: F.when(F.length(x) >= 8, clip(x, 92)))
    base = None
    for k, v in _BASES.items():
        base = F.when(sale_type == k, v) if base is None else base.when(sale_type == k, v)
    return F.coalesce(F.when(F.length(F.trim(own)) >= 4, F.trim(own)), property_, listed, F.concat_ws(" - ", base.otherwise("Sudska prodaja"), municipality))


def nominative(locative: Column, table: dict[str, str]) -> Column:
    """A town's name from its locative: by table (with and without spaces), else a regular ending taken off."""
    return once(locative, lambda c: _nominative(c, table))


def _nominative(locative: Column, table: dict[str, str]) -> Column:
    key = F.trim(F.regexp_replace(fold(locative), r"[^a-z0-9]+", " "))
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.create_map().cast("map<string,string>")
    regular = F.when(locative.rlike(r"(?iu)[bcdfghjklmnprstvzčćžšđ]u\z") & (F.length(locative) > 4), F.expr("null").cast("string")).otherwise(locative)
    cut = F.coalesce(regular, locative.substr(F.lit(1), F.length(locative) - 1))
    return F.coalesce(F.try_element_at(pairs, key), F.try_element_at(pairs, F.replace(key, F.lit(" "), F.lit(""))), cut)


#: Seats of courts with the ending that their name takes behind "u"; an alternation of the two forms by town.
_SEATS = """
Banja Luka|Banjoj Luci; Banja Luka|Banjaluci; Banovići|Banovićima; Bihać|Bihaću; Bijeljina|Bijeljini; Brčko|Brčkom; Brčko|Brčko; Breza|Breze; Bugojno|Bugojnu; Busovača|Busovači; Cazin|Cazinu; Čapljina|Čapljini;
Čitluk|Čitluku; Derventa|Derventi; Doboj|Doboju; Foča|Foči; Goražde|Goraždu; Gračanica|Gračanici; Gradačac|Gradačcu; Gradiška|Gradišci; Istočno Sarajevo|Istočnom Sarajevu; Jajce|Jajcu; Kakanj|Kaknju;
Kalesija|Kalesiji; Kiseljak|Kiseljaku; Ključ|Ključu; Konjic|Konjicu; Kotor Varoš|Kotorvarošu; Kozarska Dubica|Kozarskoj Dubici; Livno|Livnu; Lopare|Loparama; Lukavac|Lukavcu; Ljubuški|Ljubuškom; Maglaj|Maglaju;
Modriča|Modriči; Mostar|Mostaru; Mrkonjić Grad|Mrkonjićgradu; Nevesinje|Nevesinju; Novi Grad|Novomgradu; Olovo|Olovu; Orašje|Orašju; Posušje|Posušju; Prijedor|Prijedoru; Prnjavor|Prnjavoru; Prozor|Prozoru;
Sanski Most|Sanskommostu; Sarajevo|Sarajevu; Sokolac|Sokocu; Srebrenica|Srebrenici; Srebrenik|Srebreniku; Stolac|Stocu; Široki Brijeg|Širokom Brijegu; Tešanj|Tešnju; Teslić|Tesliću; Tomislavgrad|Tomislavgradu;
Travnik|Travniku; Trebinje|Trebinju; Tuzla|Tuzli; Velika Kladuša|Velikoj Kladuši; Visoko|Visokom; Višegrad|Višegradu; Vitez|Vitezu; Vlasenica|Vlasenici; Zavidovići|Zavidovićima; Zenica|Zenici; Zvornik|Zvorniku;
Žepče|Žepču; Živinice|Živinicama
"""


def seats() -> dict[str, str]:
    """Folded locatives of court seats with their nominatives."""
    plain = str.maketrans("čćžšđ", "cczsd")
    pairs = (p.strip().split("|") for p in _SEATS.replace("\n", " ").split(";"))
    return {locative.lower().translate(plain): name for name, locative in pairs}


def municipality(text: Column) -> Column:
    """The town of a text's court header, in the nominative: labels behind it go, capitals are re-cased; null without a header."""
    header = rf"(?iu)(?=[ok])(?<![\p{{L}}\p{{N}}_])(?:op[cć]inski|osnovni|kantonalni|okru[zž]ni)\s+(?:privredni\s+)?sud\s+u?\s*(\p{{L}}[\p{{L}}\p{{N}}_]+(?:[^\S\n]+\p{{L}}[\p{{L}}\p{{N}}_]+)?)"
    name = F.regexp_extract(text, header, 1)
    name = F.trim(F.regexp_replace(name, r"(?iu)\s*(?<![\p{L}\p{N}_])(?:broj|br|predmet|posl|dana|datum|sudija)(?![\p{L}\p{N}_]).*\z", ""))
    return once(name, lambda n: F.when(n != "", nominative(F.initcap(F.lower(n)), seats())))
