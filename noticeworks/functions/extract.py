"""Fields of a notice from its text, each a column expression. Boundaries are spelled out, as Java's differ by letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import DEPOSIT_CAP, MOST_PLAUSIBLE, js_round, parse_amount
from .patterns import any_of, names
from .text import case_of_capitals, fold, fold_latin, once, tidy, to_latin

#: Patterns ask for their first letters before they look behind, which takes longer.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_MARK = any_of("Ips, Ipl, Ip, I, Kom, Kmp, Mals, Mal, Ps, Pl, P, Su, Rev, Ri, Reg, Fi")
_CASE = rf"(?i)(?=\d){_B}(\d{{2,3}})\s+0\s+({_MARK})\s+(\d{{4,9}})\s+(\d{{2}})\s+({_MARK}(?:\s*\d)?){_E}"


def _some(c: Column) -> Column:
    return once(c, lambda x: F.when(x != "", x))


def case_number(text: Column) -> Column:
    """``NN 0 MARK NNNN YY MARK`` with single spaces, from Latin or Cyrillic text; null without one."""

    def spaced(found: Column) -> Column:
        parts = [F.regexp_extract(found, _CASE, k) for k in range(1, 6)]
        return F.when(found != "", F.regexp_replace(F.concat_ws(" ", parts[0], F.lit("0"), *parts[1:]), r"\s+", " "))

    return once(F.regexp_extract(to_latin(text), _CASE, 0), spaced)


def auction_round(text: Column) -> Column:
    """First, second or third hearing, asked in this order."""
    return once(folded_line(text), round_in)


def folded_line(text: Column) -> Column:
    return fold(F.regexp_replace(text, r"\n+", " "))


def round_in(t: Column) -> Column:
    """The hearing that a folded line names."""
    noun = r"(?:\S+\s+){0,2}" + any_of("rociste, rocistu, rocista, prodaj, nadmetanj")
    out = None
    for name, stem, whole in (("prvo", "prv[aeoiu]m?", "prvu"), ("drugo", "drug[aeoiu]m?", "drugu"), ("trece", "trec[aeoiu]m?g?", "trecu")):
        start = whole[:-1]
        hit = t.contains(start) & (t.rlike(rf"(?={start}){_B}(?:{stem})\s+{noun}") | t.rlike(rf"(?=rociste){_B}rociste\s+za\s+{whole}\s+prodaju"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("nepoznato")


def sale_method(text: Column) -> Column:
    return once(folded_line(text), method_in)


def method_in(t: Column) -> Column:
    """The method that a folded line names."""
    return (
        F.when(t.contains("neposredn") & t.rlike(any_of("neposredn* pogodb")), "neposredna-pogodba")
        .when(t.contains("prikupljanj") & t.rlike(any_of("prikupljanj* ponud, prikupljanj* pismenih ponud")), "prikupljanje-ponuda")
        .when(t.contains("nadmetanj") & t.rlike(any_of("usmen* nadmetanj, usmen* javn* nadmetanj, javn* nadmetanj")), "usmeno-javno-nadmetanje")
        .otherwise("nepoznato")
    )


def sale_time(text: Column) -> Column:
    """``HH:mm``; a bare hour counts in full."""
    full = rf"(?iu)(?=\d){_B}(\d\d?)[:.,] ?([0-5][0-9])\s*(?:{any_of('sat, casova', marks=True)}|h{_E})"
    bare = rf"(?iu)(?=u\s){_B}u\s+(\d\d?)\s*{any_of('sati, casova', marks=True)}{_E}"
    hour, minute = (lambda found, k=k: F.regexp_extract(found, full, k) for k in (1, 2))
    timed = once(F.regexp_extract(text, full, 0), lambda found: F.when(hour(found).try_cast("int") <= 23, F.concat(F.lpad(hour(found), 2, "0"), F.lit(":"), minute(found))))
    return F.coalesce(timed, once(F.regexp_extract(text, bare, 1), lambda alone: F.when(alone.try_cast("int") <= 23, F.concat(F.lpad(alone, 2, "0"), F.lit(":00")))))


def viewing(text: Column) -> Column:
    return _some(tidy(F.regexp_extract(text, rf"(?iu)(?=[pr][ar][ez]){_B}(?:razgledanj\w+|razgledati|pregled\w*){_E}[^.]{{0,180}}", 0)))


def venue(text: Column) -> Column:
    """The court or room of a hearing, without what follows it in the header."""
    court = F.regexp_extract(text, rf"(?iu)(?=[kopuz]){_B}(?:{any_of('u, zgradi, prostorijama')}\s+){{0,3}}{any_of('opcinskog, osnovnog, kantonalnog, okruznog, privrednog, ovog', marks=True)}\s+{any_of('suda, sudu')}[^.]{{0,140}}", 0)
    room = F.regexp_extract(text, rf"(?iu)(?=[sku]){_B}{any_of('soba, kancelarija, kancelariji, ured, sudnica, sudnici')}\s*(?:broj|br)?[. ]*[\w/.-]{{1,12}}", 0)
    v = F.coalesce(_some(court), _some(room))
    for tail in (r"\s*broj\s+\d+ +0 .*", r",?\s*(?<!\w)a\s+prodaja\s+.*", r",?\s*(?<!\w)ul\.?\s*", r",?\s*(?<!\w)od\s+\d+\s*", r",?\s*(?<!\w)dana\s+[\d.\s]*", r",?\s*(?<!\w)u\s*"):
        v = F.regexp_replace(v, rf"(?is){tail}\z", "")
    return _some(tidy(v))


_TYPES = {"NEK": "nekretnine", "VOZ": "vozila", "TEH": "tehnika", "NAM": "namjestaj", "OST": "ostalo"}


def sale_type(code: Column, label: Column) -> Column:
    """The feed's code, else its label, else other."""
    out = None
    for k, v in _TYPES.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    lab = fold(F.coalesce(label, F.lit("")))
    for pattern, v in ((r"nekretnin|nepokretn", "nekretnine"), (r"vozil|automobil", "vozila"), (r"tehnik|oprem|masin", "tehnika"), (r"namjesta|namesta", "namjestaj")):
        out = out.when(lab.rlike(pattern), v)
    return out.otherwise("ostalo")


def infer_sale_type(text: Column) -> Column:
    t = fold(text)
    rules = (
        (any_of("nekretnin, nepokretn, parcel, zemljist, poslovn* prostor, apartman") + rf"|{_B}(?:stan[auomi]?|kuc[aeiu]){_E}", "nekretnine"),
        (any_of("putnick, registarsk, teretn* vozil") + rf"|{_B}vozil|marke\s+\w", "vozila"),
        (any_of("masin, oprem, uredaj, kompresor, agregat, tehnik"), "tehnika"),
        (any_of("namjestaj, namestaj, stolic, orman, krevet"), "namjestaj"),
    )
    out = None
    for pattern, v in rules:
        out = F.when(t.rlike(pattern), v) if out is None else out.when(t.rlike(pattern), v)
    return out.otherwise("ostalo")


# --- money -----------------------------------------------------------------------------------------

#: Characters ahead of an amount that tell its role.
_AHEAD = 130
_NUMBER, _UNIT = r"\d(?:[\d.,   ]{0,18}\d)?", r"\s*(?:BAM|K\.M\.|KM)(?![A-Za-z0-9_])"
_AMOUNT = rf"(?i)(?=\d)(?<!\d)(?<!\d[.,])({_NUMBER})({_UNIT})"


def _found(t: Column) -> Column:
    """Amounts of a text in order, as ``struct<c, n, r>``: what is ahead, the number, and the rest of the line; one pass over the text."""
    bare = F.replace(F.replace(t, F.lit("\x01"), F.lit("")), F.lit("\x02"), F.lit(""))
    return once(F.split(F.regexp_replace(bare, _AMOUNT, "\x01$1\x02$2"), "\x01"), _in_order)


def _in_order(marked: Column) -> Column:
    n = F.size(marked) - 1
    start = F.struct(F.right(F.get(marked, 0), F.lit(_AHEAD)).alias("ahead"), F.lit(0).alias("i"), F.array().cast("array<struct<c:string,n:string,r:string>>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        return once(F.substring_index(s, "\x02", 1), lambda number: once(s.substr(F.length(number) + 2, F.length(s)), lambda behind: once(F.regexp_replace(behind, rf"^(?i:{_UNIT})", ""), lambda rest: with_one(state, number, behind, rest))))

    def with_one(state: Column, number: Column, behind: Column, rest: Column) -> Column:
        line = F.substring_index(rest, "\n", 1)
        more = ~F.contains(rest, F.lit("\n")) & (state["i"] + 1 < n)  # another amount follows on the line
        one = F.struct(state["ahead"].alias("c"), number.alias("n"), F.when(more, F.concat(line, F.lit("…………"))).otherwise(line).alias("r"))
        ahead = F.right(F.concat(state["ahead"], number, behind), F.lit(_AHEAD))
        return F.struct(ahead.alias("ahead"), (state["i"] + 1).alias("i"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(F.slice(marked, 2, F.greatest(n, F.lit(1))), start, step)["out"]


def amounts(text: Column) -> Column:
    """Amounts of a text in order, each with its role: debt, item, deposit, floor, appraised or unknown."""

    def one(z: Column) -> Column:
        return once(F.replace(z["c"], F.lit("\n"), F.lit(" ")), lambda context: once(fold_latin(context), lambda c: once(_role(context, c), lambda role: told(z, c, role))))

    def told(z: Column, c: Column, role: Column) -> Column:
        figure = lambda pattern: once(F.regexp_extract(c, pattern, 1), lambda x: F.when(x != "", x.try_cast("double")))
        per_cent, part = figure(r"(\d{2})\s*%"), figure(r"1\s*/\s*(\d{1,2})")
        tenth = F.coalesce(part, F.when(c.contains("desetin"), 10.0).when(c.contains("petin"), 5.0))
        of_floor = F.coalesce(once(per_cent, lambda x: F.when(x > 0, 100 / x)), F.when(c.rlike(r"trecin|1\s*/\s*3"), 3.0).when(c.rlike(r"polovin|1\s*/\s*2"), 2.0))
        near = F.contains(z["c"], F.lit("\n")) | (F.length(z["c"]) < _AHEAD)  # its line begins within what is ahead
        return F.struct(
            parse_amount(z["n"]).alias("amount"), role.alias("role"), F.when(role == "deposit", tenth).when(role == "floor", of_floor).alias("part"),
            names(c, "pocetn, najniz, polazn").alias("starting"), ((F.length(F.trim(z["r"])) <= 2) & near).alias("row"),
        )

    found = F.transform(_found(to_latin(text)), one)
    return F.filter(found, lambda a: (a["amount"] > 0) & (a["amount"] <= MOST_PLAUSIBLE))


def _role(context: Column, c: Column) -> Column:
    """What the text ahead of an amount makes of it; ``c`` is the same text folded."""
    return (
        F.when(names(c, "v.sp., radi naplate, novcanog potrazivanja, duguje, glavnog duga"), "debt")
        .when((context.contains("....") & context.rlike(r"\.{4,}\s*\z")) | (c.contains("pocetn") & c.rlike(r"(?:^|[•–-])[^:;.]{3,90}" + any_of("pocetn* cijen* od") + r"\s*\z")), "item")
        .when(names(c, "jemstv, ucesc, osiguranj, kapar, depozit, predujam, garantni"), "deposit")
        .when(names(c, "ispod, manje od, najniz, pocetn, polazn, ne smije") | (c.contains("prodati") & c.rlike(r"ne\s+moze\s[^.]{0,30}prodati")), "floor")
        .when(names(c, "utvrden, procijenjen, procjenjen, procenjen, trzisn, vrijednost, vrednost, iznose, iznosi, vrijede"), "appraised")
        .otherwise("unknown")
    )


def money(found: Column) -> Column:
    """Appraisal, starting price, deposit and the total printed, from classified amounts."""
    free = lambda a: a["row"] & ~a["role"].isin("debt", "deposit", "floor")

    def of_roles(found: Column, rows: Column) -> Column:
        roles = F.transform(found, lambda x: F.struct(x["amount"].alias("amount"), F.when(rows & free(x), "item").otherwise(x["role"]).alias("role"), x["part"].alias("part"), x["starting"].alias("starting")))
        printed = F.aggregate(found, F.lit(0.0), lambda s, x: s + x["amount"])
        return once(roles, lambda a: once(_candidates(a), lambda c: _settled(c, printed)))

    # a list of prices is told before any appraisal is read
    return once(found, lambda f: once(F.size(F.filter(f, free)) >= 2, lambda rows: of_roles(f, rows)))


def _candidates(a: Column) -> Column:
    """What amounts with roles offer: floor, the least that the items come to, an appraisal, a deposit."""
    of = lambda role: F.filter(a, lambda x: x["role"] == role)
    most = lambda role: F.array_max(F.transform(of(role), lambda x: x["amount"]))
    items = F.aggregate(of("item"), F.lit(0.0), lambda s, x: s + x["amount"])
    derived = F.get(F.concat(F.filter(of("floor"), lambda x: x["part"].isNotNull()), F.filter(of("deposit"), lambda x: x["part"].isNotNull())), 0)
    deposit = F.get(F.filter(of("deposit"), lambda x: x["amount"] <= DEPOSIT_CAP), 0)["amount"]
    return F.struct(items.alias("items"), F.exists(of("item"), lambda x: x["starting"]).alias("as_start"), most("floor").alias("floor"), most("appraised").alias("appraised"), once(derived, lambda d: d["amount"] * d["part"]).alias("derived"), deposit.alias("deposit"))


def _settled(c: Column, printed: Column) -> Column:
    sum_ = F.when((c["items"] > 0) & (c["items"] <= MOST_PLAUSIBLE), c["items"])
    both = F.struct(F.coalesce(c["appraised"], F.when(~c["as_start"], sum_), c["derived"]).alias("value"), F.coalesce(c["floor"], F.when(c["as_start"], sum_)).alias("floor"))
    return once(both, lambda b: F.struct(
        js_round(b["value"]).alias("appraised"), js_round(F.when(b["value"].isNull() | (b["floor"] <= b["value"] * 1.01), b["floor"])).alias("starting"), js_round(c["deposit"]).alias("deposit"), printed.alias("printed"),
    ))


# --- cadastral ----------------------------------------------------------------------------------------

#: Stems of procedure and of regions, on folded names.
_NO_PLACE = any_of(
    "prodaj, zakljuc, izvrs, rocist, nekretnin, pokretn, kanton, zupanij, nadmetanj, osiguranj, vozil, motorn, predmet, ugovor, vlasnistv, iznos, marak, sudij, kupac, "
    "distrikt, federacij, republik, entitet, opcin, opstin"
)


def is_place(name: Column) -> Column:
    """Whether a name can be a place's: letters that can be said, no ordinal, person, procedure or region."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return (
        (F.length(name) <= 60) & (letters >= 3) & name.rlike(r"(?i)[aeiour]") & ~fold(name).rlike("^" + any_of("prv, drug, trec, cetvrt, pet") + r"(?:oj|om|og|em|[aoeiu])?\z")
        & ~name.rlike(r"^\p{Lu}\p{L}+\s+\p{Lu}\p{L}*[oe]vi[ćc]\z") & ~fold(name).rlike(_NO_PLACE)
    )


def clean_places(names: Column) -> Column:
    bare = F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"^(?:S|N)[.]? ?P(?:[.]?undefined)?[^\p{L}\p{N}]*(?=\p{Lu})", ""), r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(bare, is_place)), 1, 25)


def clean_numbers(values: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.rlike(r"^\d{1,7}(?:/\d{1,4})?\z"))), 1, 25)


def sanitised(kc: Column, zk: Column, ko: Column) -> Column:
    """A record of parcels, folios and places; null if nothing in it is sound."""
    record = F.struct(clean_numbers(kc).alias("kc"), clean_numbers(zk).alias("zk_ulozak"), clean_places(ko).alias("ko"))
    return once(record, lambda r: F.when((F.size(r["kc"]) + F.size(r["zk_ulozak"]) + F.size(r["ko"])) > 0, r))


def cadastral(text: Column) -> Column:
    return once(to_latin(text), _cadastral)


def _cadastral(t: Column) -> Column:
    name = r"\p{Lu}[-_\p{L}\p{N}]+"
    number = r"(?:broj|br)?[. ]*"
    kc = F.regexp_extract_all(t, F.lit(rf"(?iu)(?=[kp]){_B}{any_of('k.c., parcel*', marks=True)}[. ]*{number}(\d+(?:/\d+)?)"), 1)
    zk = F.regexp_extract_all(t, F.lit(rf"(?iu)(?=[zž]){_B}{any_of('z.k., zemljisnoknjizn*', marks=True)}[. ]*{any_of('ulozak, ul.', marks=True)}?\s*{number}(\d+(?:/\d+)?)"), 1)
    ko = F.regexp_extract_all(t, F.lit(rf"(?=[Kk])(?<!\p{{L}})(?<!\p{{N}})[Kk][. ]{{0,2}}[Oo][.]?\s+((?:[SN]P[_ ]*)?{name}(?:\s+{name})?)"), 1)
    return sanitised(kc, zk, ko)


def settlement(ko: Column) -> Column:
    """The first place of a record without its district; capitals alone are re-cased."""
    first = F.get(clean_places(ko), 0)
    name = F.trim(F.regexp_replace(F.regexp_replace(first, r"(?i)[ –-]*mahala\s+[CILVX]+[.]?\z", ""), r"\s+(?:[CILVX]{1,6}|\d\d?)[.]?\z", ""))
    return once(name, lambda n: F.when(is_place(n), case_of_capitals(n)))


# --- what is sold ----------------------------------------------------------------------------------

#: Tags in their order, with stems on folded text; the first found is the main one. A leading ^ asks for the start of a word.
TAGS: dict[str, tuple[str, ...]] = {
    "monitor": ("^monitor", "ekran"), "laptop": ("^laptop", "notebook", "prijenosn"), "racunar": ("^racunar", "kompjuter", "desktop", "^pc$"), "printer": ("^stampac", "printer", "skener", "fotokopir"),
    "server": ("^server$", "router", "ruter", "^ups$"), "telefon": ("^telefon", "mobitel", "smartphone"), "tv": ("^televizor", "^tv$", "plazma"), "audio": ("^zvucnik", "pojacalo", "mikrofon", "kamera", "projektor"),
    "frizider": ("^frizider", "zamrziva"), "vesmasina": ("^ves masin", "^vesmasin", "masina za pranje", "sudoper", "susilic"), "sporet": ("^sporet", "pecnic", "mikrovaln", "stednjak"), "klima": ("^klima", "klimatiza", "grijalic", "radijator", "kotao"),
    "kancelarijski": ("^radni sto", "pisaci sto", "kancelarijski sto"), "stolice": ("^stolic", "fotelj"), "ormari": ("^ormar", "orman", "^polic", "regal", "vitrin", "komod"), "kreveti": ("^krevet", "lezaj", "madrac", "kauc", "trosjed", "dvosjed"),
    "stolovi": ("^stolov", "^stol$", "trpezarijsk"), "putnicko": ("^automobil", "^pmv$", "putnicko vozil", "putnicko motorno vozil"), "teretno": ("^kamion", "^tmv$", "kiper", "cisterna", "tegljac", "teretno"), "kombi": ("^kombi", "minibus", "furgon"),
    "autobus": ("^autobus",), "motocikl": ("^motocikl", "^moped", "skuter"), "bicikl": ("^bicikl",), "prikolica": ("^prikolic", "poluprikolic"), "plovila": ("^camac", "plovil", "brodic", "gliser"),
    "viljuskar": ("^viljuskar", "forklift"), "gradjevinske": ("^bager", "utovariva", "rovokopac", "mjesalic", "kompresor", "skela", "dizalic"), "drvo": ("^cirkular", "blanjalic", "cepac"), "metal": ("^strug$", "tokarski", "glodalic", "brusilic", "varilic"),
    "tekstil": ("^sivac", "overlok", "pletac"), "alat": ("^busilic", "alat$", "aparat za"), "agregat": ("^agregat", "generator", "pumpa", "hidrofor"), "traktor": ("^traktor",), "poljoprivredna": ("^plug$", "kosacic", "sijacic", "drljac", "prskalic", "kombajn"),
    "stoka": ("^krav", "^junad", "^junic", "^ovc", "svinj", "^stoka$", "^konj$", "^pcel"), "ugostiteljska": ("^sank$", "espresso", "tocionik", "rostilj", "friteza", "ugostiteljsk"), "trgovacka": ("^fiskaln", "^kasa$", "^vaga$", "^zalih", "^artikl"),
    "stan": ("^stan$", "stana$", "stanu$", "apartman"), "kuca": ("^kuca$", "kuce$", "kucu$", "stambeni objek"), "poslovni": ("^poslovni prostor", "poslovnog prostor", "hala$", "magacin", "skladist"), "garaza": ("^garaz",), "zemljiste": ("^zemljist", "parcel", "njiv", "livad", "pasnjak", "vocnjak", "oranic"),
}


def tag_pattern(stems: tuple[str, ...]) -> str:
    """One pattern of stems, without lookaround, so that any engine reads it alike."""
    return "|".join(s.replace("^", r"\b", 1).replace("$", r"\b") for s in stems)


def item_tags(title: Column, description: Column, body: Column | None = None, tags: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Tags in title and description, in the tags' order; of the body only if those have none."""
    tags = tags or TAGS

    def of(c: Column) -> Column:
        return once(c, lambda t: F.array_compact(F.array(*(F.when(_names(t, s), F.lit(tag)) for tag, s in tags.items()))))

    own = of(fold(F.concat_ws("\n", title, description)))
    return own if body is None else once(own, lambda o: F.when(F.size(o) > 0, o).otherwise(of(fold(F.coalesce(body, F.lit(""))))))


def _names(c: Column, stems: tuple[str, ...]) -> Column:
    """Whether a text holds any of the stems; a plain one is sought as it is, before its pattern asks for the ends of words."""
    hit = F.lit(False)
    for s in stems:
        plain = s.removeprefix("^").removesuffix("$")
        one = c.contains(plain) if plain.replace(" ", "").isalnum() else F.lit(True)
        hit = hit | (one if plain == s and plain.replace(" ", "").isalnum() else one & c.rlike(tag_pattern((s,))))
    return hit


def with_reading(df: DataFrame, text: Column, title: Column, name: str = "rules") -> tuple[DataFrame, dict[str, Column]]:
    """The rows with the rules' whole reading of their notices as columns, and these by field.

    Columns are made once, however often they are used, and not at all if they aren't; a struct would be made whole or again for each use.
    """
    from .merge import municipality  # merge builds on this module

    t, flat, line = (F.col(f"_{name}_{x}") for x in ("text", "flat", "line"))
    df = df.withColumn(f"_{name}_text", to_latin(F.concat_ws("\n", F.coalesce(title, F.lit("")), text)))
    df = df.withColumn(f"_{name}_flat", F.regexp_replace(t, r"\n+", " ")).withColumn(f"_{name}_line", fold(flat))
    fields = {
        "case_number": case_number(t), "money": money(amounts(t)), "auction_round": round_in(line), "sale_method": method_in(line), "sale_time": sale_time(flat),
        "auction_location": venue(flat), "viewing_info": viewing(flat), "cadastral": cadastral(t), "municipality": municipality(t),
    }
    df = df.withColumns({f"_{name}_{f}": c for f, c in fields.items()}).drop(*(f"_{name}_{x}" for x in ("text", "flat", "line")))
    return df, {f: F.col(f"_{name}_{f}") for f in fields}
