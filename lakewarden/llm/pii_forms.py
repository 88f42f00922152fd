"""Grammars of personal information and of what looks like it, for composing training texts with exact spans.

Given names are a short list a language; family names, streets, places, systems and most given names are spelt by rule (syllables, stems and
endings of several languages), so a tagger trained on them meets new spellings in every text and must learn forms and contexts, not entries.
Nothing here is taken from the tables the tagger is used on.
"""

from __future__ import annotations

import numpy as np

#: Ordinary given names, a few a language (fixed values).
GIVEN = {
    "en": "James Mary Robert Linda Michael Susan David Karen Richard Nancy Thomas Lisa Charles Betty Daniel Sandra Mark Ashley Steven Emily Andrew Donna Kevin Carol Brian Laura George Helen Jason Anna Ryan Emma Jacob Olivia Eric Grace".split(),
    "de": "Hans Anna Peter Ursula Klaus Monika Wolfgang Petra Jürgen Sabine Dieter Renate Uwe Heike Stefan Birgit Matthias Karin Torsten Anke Lukas Lena Florian Katrin Sven Jana Günter Silke Ralf Gisela".split(),
    "fr": "Jean Marie Pierre Françoise Michel Monique André Nathalie Philippe Isabelle Alain Sylvie Bernard Martine Éric Sophie Laurent Céline Julien Chloé Mathieu Élodie Guillaume Amélie Thierry Camille".split(),
    "es": "José María Antonio Carmen Manuel Ana Francisco Laura Javier Cristina Carlos Marta Miguel Lucía Pedro Pilar Álvaro Elena Sergio Raquel Pablo Rocío Andrés Inés Jorge Beatriz".split(),
    "xx": "Wei Mei Hiroshi Yuki Ahmed Fatima Omar Leila Priya Raj Amit Sunita Ivan Olga Dmitri Natasha Kofi Amara Chinedu Ngozi Marek Katarzyna Piotr Agnieszka Giulia Marco Luca Ingrid Lars Astrid Erik Yusuf Zeynep Mateo Noor Tomasz".split(),
}
#: Ordinary family names of several languages (fixed values).
FAMILY = (
    "Smith Johnson Williams Brown Jones Davis Miller Wilson Moore Taylor Jackson White Harris Martin Clark Lewis Walker Hall Allen Young King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Koch Bauer Richter Klein Wolf Braun Krause Lehmann Köhler Martin Bernard Dubois Petit Durand Leroy Moreau Simon Laurent Michel Roux Fournier Mercier Blanc Garnier "
    "García Martínez López Sánchez Pérez Gómez Ruiz Díaz Álvarez Moreno Muñoz Romero Torres Vázquez Ramos Silva Santos Ferreira Rossi Russo Ferrari Ricci Kim Lee Park Chen Wang Singh Patel Khan Ali Hassan Ivanov Novak Kowalski Nowak Jensen Hansen Larsen Johansson Virtanen de-Vries Jansen Bakker Suzuki Sato Mensah Adeyemi Yilmaz Demir"
).split()
STEMS = "ack al and ard ash bal bar beck ben berg black blan bor bran brook burk cal car chan clark col cor dal dan dor drey eck ell em esch fal fer fin fisch flem gar gil gold gran grub hal ham har hart haw heim hol horn hub jen kam karl kel kern kov kram lam lan leh lin lor mal mar mart mel mey mil mont mor mull nak nav nel nor oak ol or pan park per pet pic pol quin ram red reyn rich ros rus sal san schul sel ser sim sol stein stur tan thom tor tur val var ver vil vog wal wat web wel whit wil win wolf yam zel zim".split()
ENDINGS = {
    "en": "son ton ford well er ley man field by worth s ham wick wood ell ings more".split(),
    "de": "mann bauer meister hardt er inger stein berg hoff feld rich ler ke".split(),
    "fr": "eau ier ard et aux ot in eux elle ois ault ac".split(),
    "es": "ez ero ado illa ales ín ano eda osa era ón ar".split(),
    "xx": "ov ova ski ska ić enko yan oğlu ato ura ani dze esh umar elli ucci sen qvist nen ade".split(),
}
VOWELS, HEADS, TAILS = "a e i o u a e i o ai ei ie ou ia".split(), "b c d f g h j k l m n p r s t v w z br ch dr fl gr kl kr pr sch sh st th tr".split(), ["", "", "", "l", "n", "r", "s", "m", "t", "k", "nd", "rt", "x"]
TITLES = {"en": "Mr. Mrs. Ms. Dr. Prof. Mr Mrs Ms Dr Miss Sir".split(), "de": "Herr Frau Dr. Prof. Herrn".split(), "fr": "M. Mme Mlle Dr Pr Monsieur Madame".split(), "es": "Sr. Sra. Dr. Dra. Don Doña Sr Sra".split(), "xx": "Mr. Dr. Ms. Prof.".split()}
TLDS = "com org net de fr es it uk co.uk io eu info edu gov ch at nl pl example test biz me dev".split()
PLACES_AFTER = "Bay Point Hill Bridge Park Valley Lake Harbour Beach Springs Falls Ridge Heights Island Square Station Airport Cove Forest".split()
PLACES_BEFORE = "Lake San New Santa Saint Mount Fort Cape Port Green Silver North South East West Great Upper Rio Villa Bad Los Las El La Le".split()
ORGANISED = "Cloud Software Works Energy Media Motors Airlines Foods Holdings Partners Capital Labs Networks Solutions Logistics Hospital School Institute Museum Hotel Street Fund Union Press Times Halls Wing Tower".split()
UNITS_AFTER = "Office Team Group Department Council Board Desk Portal Archive Ledger Workspace Service System Platform Programme Committee University Bank Insurance Ltd GmbH Inc Report Policy Handbook Review Manual Calendar Dashboard Tracker".split()
UNITS_BEFORE = {"de": "Standort Bereich Abteilung System Programm Formular Richtlinie Projekt Stadt Regel Heft Fach Verzeichnis Eintrag Portal Firma".split(), "fr": "Système Projet Service Société Ville Portail Dossier Note Programme Site Agence".split(), "es": "Sistema Proyecto Servicio Empresa Ciudad Portal Norma Programa Sede Cuaderno Agencia".split(), "en": "Project System Site Form Rule Unit Tenant Area Team Version City Port Lake Mount Saint".split(), "xx": ["Project", "System"]}
LANGS = ["en", "de", "fr", "es", "xx"]


class Forms:
    """Random forms of each kind, (text, kind), and of look-alikes with kind None."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.plain = [x.lower() for x in [*PLACES_AFTER, *UNITS_AFTER]]  # ordinary words

    def of(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def n(self, lo: int, hi: int) -> int:
        return int(self.rng.integers(lo, hi + 1))

    def digits(self, count: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, count)))

    def groups(self, *sizes: int, by: str = " ") -> str:
        return by.join(self.digits(k) for k in sizes)

    def letters(self, count: int) -> str:
        return "".join(self.of("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(count))

    def made(self, least: int = 2, most: int = 3) -> str:
        """An invented word."""
        return "".join(self.of(HEADS) + self.of(VOWELS) + self.of(TAILS) for _ in range(self.n(least, most))).capitalize()

    def word(self, lang: str) -> str:
        """A word in the shape of a proper noun: a stem with an ending, two stems, or invented."""
        roll = self.rng.random()
        if roll < 0.55:
            return (self.of(STEMS) + self.of(ENDINGS[lang])).capitalize()
        if roll < 0.72:
            return (self.of(STEMS) + self.of(STEMS)).capitalize()
        if roll < 0.86:
            return (self.of(STEMS) + self.made(1, 2).lower() + self.of(ENDINGS[self.of(LANGS)])).capitalize()
        return self.made()

    def title(self) -> str:
        """A title or place of ordinary words, some with an invented one."""
        words = [self.of(self.plain).capitalize() for _ in range(self.n(1, 3))]
        if len(words) == 1 or self.chance(0.35):
            words.insert(0, self.of([self.word(self.of(LANGS)), self.made(), self.of(PLACES_BEFORE)]))
        return " ".join(words)

    def given(self, lang: str) -> str:
        roll = self.rng.random()
        if roll < 0.42:
            name = self.of(GIVEN[lang])
        elif roll < 0.7:  # the head of one name and the tail of another
            a, b = self.of(GIVEN[self.of(LANGS)]), self.of(GIVEN[lang])
            name = (a[: max(2, len(a) // 2)] + b[len(b) // 2 :]).capitalize()
        else:
            name = self.made(1, 2) + self.of(["", "a", "o", "e", "in", "is", "us", "y"])
        return f"{name}-{self.of(GIVEN[lang])}" if self.chance(0.03) else name

    def family(self, lang: str) -> str:
        name = self.of(FAMILY) if self.chance(0.3) else self.word(lang)
        roll = self.rng.random()
        if roll < 0.04:
            return self.of(["O'", "O’", "Mc", "Mac", "D'", "d’"]) + name
        if roll < 0.08:
            return self.of(["van ", "van der ", "de ", "von ", "de la ", "del ", "di ", "al-", "Le ", "zu "]) + name
        if roll < 0.12:
            return f"{name}-{self.word(lang)}"
        if lang == "es" and roll < 0.3:
            return f"{name} {self.word(lang)}"
        return name

    def person_name(self, lang: str) -> str:
        roll = self.rng.random()
        first, last = self.given(lang), self.family(lang)
        if roll < 0.50:
            out = f"{first} {last}"
        elif roll < 0.58:
            out = f"{first} {self.of('ABCDEFGHJKLMNPRSTVW')}. {last}"
        elif roll < 0.70:
            out = f"{first[0]}. {last}"
        elif roll < 0.73:
            out = f"{first[0]}.{self.of([' ', ''])}{self.of('ABCDEFGHJKLMNPRSTVW')}. {last}"
        elif roll < 0.86:
            out = f"{self.of(TITLES[lang])} {self.of(['', '', first + ' ', first[0] + '. '])}{last}"
        elif roll < 0.95:
            out = f"{last}, {first}" + self.of(["", "", f" {self.of('ABCDEFGHJ')}."])
        else:
            out = f"{first} {self.given(lang)} {last}"
        return out

    def email(self, lang: str) -> str:
        a, b = self.given(lang).lower(), self.family(lang).lower().replace(" ", "")
        local = self.of([f"{a}.{b}", f"{a[0]}.{b}", f"{a[0]}{b}", f"{a}_{b}", f"{b}", f"{a}{self.n(1, 99)}", f"{b}.{a}+{self.made(1, 1).lower()}", self.made().lower(), f"{a}-{b}{self.digits(2)}", f"{a}%{b}"]).replace("'", "").replace("’", "")
        host = self.of([self.made().lower(), f"{self.made(1, 1).lower()}-{self.made(1, 1).lower()}", f"mail.{self.made().lower()}", self.word(lang).lower()])
        top = self.of(TLDS)
        roll = self.rng.random()
        if roll < 0.62:
            out = f"{local}@{host}.{top}"
        else:
            at = self.of([" at ", " [at] ", "[at]", " (at) ", "(at)", " {at} ", " arroba ", " [ät] ", " (arroba) "])
            dot = self.of([" dot ", " [dot] ", "[dot]", " (dot) ", " punto ", " punkt ", " point ", "."])
            if at in (" at ", " arroba ") and dot == ".":
                dot = " dot "
            out = local.replace(".", dot if self.chance(0.3) and dot.strip() in ("dot", "[dot]", "(dot)") else ".") + at + host.replace(".", dot) + dot + top.replace(".", dot)
        return out.upper() if self.chance(0.05) else out

    def phone(self, lang: str) -> str:
        d, g = self.digits, self.groups
        code = self.of(["1", "44", "49", "33", "34", "39", "31", "41", "43", "48", "351", "420", "91", "81", "55"])
        body = self.of([g(3, 3, 4), g(2, 4, 4), g(2, 3, 4), g(3, 7), g(3, 3, 3), g(1, 2, 2, 2, 2), g(4, 6), g(4, 3, 3), g(2, 8), g(3, 3, 2, 2), g(2, 3, 2, 2), d(9), d(10)])
        by = self.of([" ", " ", "-", "."])
        intl = self.of(["+", "+", "+", "00"]) + code + self.of([" ", " ", "-", ""]) + self.of(["", "", "", "(0)", "(0) "]) + body.replace(" ", by)
        national = self.of([
            "0" + g(2, 4, 4), "0" + g(4, 6), "0" + g(3, 3, 4), "0" + g(1, 2, 2, 2, 2), "0" + d(3) + "/" + d(7), "0" + d(3) + self.of([" ", "-"]) + d(7), "0" + d(2) + " " + d(8),
            f"({d(3)}) {d(3)}-{d(4)}", g(3, 3, 4, by="-"), g(3, 3, 4, by="."), g(3, 3, 4), "1-" + g(3, 3, 4, by="-"), f"(0{d(2)}) {g(4, 4)}", f"(0{d(4)}) {d(6)}", f"(0{d(1)}) {g(2, 2, 2, 2)}", "07" + d(3) + " " + d(6), self.of("679") + d(2) + " " + g(3, 3), self.of("679") + d(2) + " " + g(2, 2, 2), "0" + d(10), self.of("679") + d(1) + " " + g(3, 2, 2), "555-" + d(4), g(3, 3, 4, by="-"), "0" + g(1, 2, 2, 2, 2, by="."), f"(0{d(3)}) {d(6)}-{d(2)}",
        ])
        out = intl if self.chance(0.45) else national
        if self.chance(0.12):
            out += self.of([" ext. ", " x", " ext ", " Ext. "]) + d(self.n(2, 4))
        return out

    def id_number(self, lang: str) -> str:
        d, g = self.digits, self.groups
        return self.of([
            lambda: g(3, 2, 4, by="-"), lambda: g(3, 2, 4), lambda: d(8) + self.letters(1), lambda: d(8) + "-" + self.letters(1), lambda: self.of("XYZ") + d(7) + self.letters(1), lambda: self.letters(2) + d(6) + self.of("ABCD"),
            lambda: self.letters(2) + " " + g(2, 2, 2) + " " + self.of("ABCD"), lambda: self.letters(1) + d(8), lambda: self.letters(2) + d(7), lambda: self.letters(1) + d(7), lambda: self.of("12") + " " + g(2, 2, 2, 3, 3) + self.of(["", " " + d(2)]),
            lambda: self.of("12") + d(12) + self.of(["", d(2)]), lambda: g(2, 3, 3, 3), lambda: d(11), lambda: g(2, 3, 5, by="/"), lambda: g(2, 3, 3, 3, by="/"), lambda: g(2, 4, 3, by="-") + "-" + self.letters(1), lambda: self.letters(6) + d(2) + self.letters(1) + d(2) + self.letters(1) + d(3) + self.letters(1), lambda: d(9), lambda: d(10), lambda: self.letters(1) + d(2) + self.letters(2) + d(4),
        ])()

    def street_address(self, lang: str) -> str:
        no, roll = str(self.n(1, 399)) + (self.of("abc") if self.chance(0.08) else ""), self.rng.random()
        name = self.word(lang) if roll < 0.6 else self.of("Main Church Mill Park High King Queen Station Garden Rose Oak Elm Maple Cedar Lake Hill River Spring Market School North South West Bridge Green Orchard Meadow Willow Victoria Windsor Copper Salt Fox Tannery Candle".split()) + (self.of(["", "", "field", "gate", "stone", "wood"]))
        if lang == "de":
            return self.of([f"{name}{self.of(['straße', 'strasse', 'weg', 'gasse', 'platz', 'allee', 'str.'])} {no}", f"{name}er {self.of(['Straße', 'Weg', 'Allee', 'Platz'])} {no}", f"{self.of(['Am', 'An der', 'Im', 'Auf dem', 'Zum', 'Unter den'])} {name} {no}"])
        if lang == "fr":
            of = self.of(["", "de ", "du ", "des ", "de la ", "de l'", "d'"])
            return f"{no}{self.of(['', '', ' bis', ' ter'])}{self.of([' ', ', ', ' '])}{self.of(['rue', 'avenue', 'boulevard', 'place', 'allée', 'impasse', 'chemin', 'quai', 'Rue', 'Avenue', 'route'])} {of}{name}"
        if lang == "es":
            of = self.of(["", "de ", "del ", "de la ", "de los "])
            return f"{self.of(['Calle', 'calle', 'Avenida', 'Plaza', 'Paseo', 'C/', 'Av.', 'Camino', 'Ronda', 'Carrera'])} {of}{name}{self.of([' ', ' ', ', '])}{no}"
        if lang == "xx":
            return self.of([f"Via {self.of(['', '', 'della ', 'dei '])}{name} {no}", f"Piazza {name} {no}", f"{name}straat {no}", f"{name}gatan {no}", f"ul. {name} {no}", f"Rua {name}, {no}", f"{name}vej {no}"])
        kind = self.of("Street Road Lane Avenue Drive Close Court Crescent Terrace Row Way Place Square Grove Gardens Hill Walk St Rd Ave Dr Blvd Boulevard Ln St. Rd. Ave. Parade Mews".split())
        return f"{no} {self.of(['', '', '', 'North ', 'Old ', 'Upper ', 'E. '])}{name} {kind}"

    def look_alike(self, lang: str) -> str:
        """Something that is none of the kinds."""
        d, g, made = self.digits, self.groups, self.made
        return self.of([
            lambda: f"{self.word(lang)} {self.of(PLACES_AFTER)}", lambda: f"{made()} {self.of(UNITS_AFTER)}", lambda: f"{self.word(lang)} {self.of(UNITS_AFTER)}", lambda: f"{self.of(UNITS_BEFORE[lang])} {self.word(lang)}", lambda: f"{self.of(UNITS_BEFORE[lang])} {made()}", lambda: f"{self.of(UNITS_BEFORE[lang])} {self.letters(2)}-{d(4)}",
            lambda: made(3, 4), lambda: self.word(lang), lambda: f"{self.letters(2)}-{d(4)}", lambda: f"{self.of(['Invoice', 'Ticket', 'Order', 'Serial', 'Batch', 'Rechnung', 'Facture', 'Factura', 'Case', 'Lot', 'Part', 'Pedido', 'Commande'])} {self.of([g(2, 2, 4, 1, by='-'), g(2, 4, 2, by='-'), g(4, 4, 4), g(4, 2, 4, by='-'), d(7), d(10), self.letters(2) + '-' + d(6), d(3) + '-' + d(3)])}",
            lambda: g(4, 4, 4, 4), lambda: g(4, 2, 4, by="-"), lambda: ".".join(str(self.n(0, 255)) for _ in range(4)), lambda: f"{self.n(1, 28):02}.{self.n(1, 12):02}.{self.n(1980, 2030)}", lambda: f"{self.n(1980, 2030)}-{self.n(1, 12):02}-{self.n(1, 28):02}", lambda: f"{self.n(1, 28)}/{self.n(1, 12)}/{self.n(1980, 2030)}", lambda: f"{self.n(1, 28)} {self.of('January February March April May June July August September October November December'.split())} {self.n(1980, 2030)}",
            lambda: f"{self.n(1, 999):,}{self.of(['', ',' + d(3), ',' + d(3) + ',' + d(3)])} {self.of(['EUR', 'USD', 'credits', 'units', 'pages', 'kilobytes'])}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{self.n(1, 99)} {self.of(['employees', 'answers', 'reviewers', 'Seiten', 'pages', 'personas', 'copies'])} {self.of(['of', 'in', 'from', 'per'])} {self.of(['one place', 'each court', 'a row', 'the street', 'every lane'])}",
            lambda: f"{self.of(['room', 'Room', 'Flat', 'Unit', 'Building', 'Chapter', 'Section', 'Page', 'Level', 'Gate', 'Raum', 'Seite', 'Sala', 'Salle', 'Apartment'])} {self.n(1, 400)}", lambda: f"week {self.n(1, 52)}", lambda: f"{self.n(2000, 2030)}-{self.n(2000, 2030)}", lambda: f"@{made().lower()}", lambda: f"{made().lower()}.{self.of(['pdf', 'txt', 'csv', 'md'])}", lambda: f"https://{made().lower()}.{self.of(TLDS)}/{made().lower()}", lambda: f"v{self.n(1, 9)}.{self.n(0, 20)}.{self.n(0, 99)}", lambda: f"{made().lower()}@{made().lower()}", lambda: f"{self.n(2, 30)} {self.of(['@', 'x', '×'])} {self.n(2, 400)}",
            lambda: f"{self.n(1, 60)}:{self.n(10, 59)}-{self.n(1, 60)}:{self.n(10, 59)}", lambda: f"{self.word(lang)} and {self.word(lang)}", lambda: f"{self.word(lang)} and {made()}", *[lambda: f"{self.of(PLACES_BEFORE)} {self.of([self.word(lang), made(), self.given(lang), self.of(self.plain).capitalize()])}"] * 3, *[lambda: f"{self.of([self.word(lang), made(), self.of(self.plain).capitalize()])} {self.of(PLACES_AFTER)}"] * 2, lambda: f"{self.word(lang)} {self.of(ORGANISED)}", lambda: self.of(["North America", "United Kingdom", "New York", "South Korea", "Santa Fe", "Los Angeles", "Nova Scotia", "Baden-Baden", "Costa Rica", "Saint Malo"]), lambda: f"{self.n(1, 30)} at {self.n(1, 9)} dot {self.n(1, 9)}", lambda: f"{self.n(1, 9)} {self.of(['street', 'road', 'lane'])} {self.of(['lamps', 'signs', 'works'])}",
            self.title, self.title, self.title, self.title, lambda: self.title().upper(), lambda: f"{self.title()} {self.n(1, 99)}", lambda: f"{self.n(1, 99)} {self.title()}", lambda: f"{self.made()} {self.of(self.plain).capitalize()}", lambda: f"{self.word(lang)} {self.of(self.plain).capitalize()}", lambda: f"{self.of(self.plain).capitalize()} {self.made(3, 4)}",
            lambda: f"{self.of(['Part no.', 'Item', 'Teil', 'Ref.', 'Art.', 'Model', 'SKU', 'Pièce', 'Asset'])} {self.of([self.letters(2) + '/' + d(4) + '/' + d(2), self.letters(2) + d(6), d(2) + '/' + d(4) + '/' + d(3), self.letters(1) + d(4) + '-' + d(3), self.letters(3) + d(5)])}",
            lambda: f"{self.of(GIVEN[lang])}", lambda: f"{self.of(PLACES_AFTER)} {self.n(1, 99)}", lambda: f"checksum {d(8)}{self.letters(1).lower()}", lambda: f"{self.of(['the', 'The', 'at', 'At'])} {made()} {self.of(['site', 'gateway', 'team', 'portal', 'office'])}",
        ])()


CUES = {
    "id_number": {"en": ["SSN", "SSN:", "social security number", "passport", "passport no.", "passport number is", "tax ID", "national ID", "ID number", "National Insurance number", "ID card", "taxpayer number", "NINO"], "de": ["Steuer-ID", "Ausweisnummer", "Reisepass", "Personalausweis Nr.", "Passnummer", "Steuernummer", "Sozialversicherungsnummer"], "fr": ["passeport", "NIR", "numéro de sécurité sociale", "carte d'identité", "numéro fiscal", "passeport n°"], "es": ["DNI", "NIE", "pasaporte", "NIF", "número de la seguridad social", "DNI n.º"], "xx": ["codice fiscale", "passport", "ID", "PESEL", "BSN"]},
    "phone": {"en": ["call", "phone", "Tel.", "tel:", "mobile", "Phone:", "ring", "reach me on", "fax", "call me at", "Cell", "my number is", "number:"], "de": ["Tel.", "Telefon", "Rufnummer", "Handy", "Fax", "anrufen unter", "erreichen Sie mich unter"], "fr": ["tél.", "téléphone", "Tél :", "portable", "appelez le", "joindre au"], "es": ["teléfono", "tel.", "móvil", "llame al", "Tfno."], "xx": ["tel.", "tel", "phone"]},
    "email": {"en": ["email", "write to", "contact", "e-mail:", "mail", "send it to"], "de": ["E-Mail", "schreiben an", "Kontakt:", "per Mail an"], "fr": ["courriel", "écrire à", "mél :", "contact :"], "es": ["correo", "escribir a", "correo electrónico:", "contacto:"], "xx": ["email", "mail:"]},
    "street_address": {"en": ["lives at", "deliver to", "address:", "ship to", "moved to", "of", "residing at", "home address"], "de": ["wohnt", "Adresse:", "Lieferung an", "Anschrift", "wohnhaft", "gemeldet in der"], "fr": ["habite", "adresse :", "livraison au", "domicilié au", "demeure"], "es": ["vive en", "dirección:", "entrega en", "domicilio:", "reside en"], "xx": ["abita in", "address", "woont", "indirizzo:"]},
    "person_name": {"en": ["ask", "by", "signed by", "contact", "with", "from", "employee", "said", "met", "for", "Dear", "manager", "Regards,", "interview with", "cc", "and", "attended by", "patient", "reported by"], "de": ["von", "mit", "Ansprechpartner", "Frau", "gezeichnet", "bei", "Kollege", "Gruß,", "an", "und", "Gespräch mit"], "fr": ["par", "avec", "de", "signé", "contacter", "chez", "Bonjour", "pour", "et", "entretien avec", "joindre"], "es": ["por", "con", "de", "firmado por", "contactar a", "para", "según", "y", "Entrevista con"], "xx": ["by", "with", "from", "signed"]},
}
TEMPLATES = {
    "en": ["Please {c} {x} before {o}.", "{X} will join the call on {o}.", "The request came {c} {x}, and the desk closed it.", "Our records show {c} {x} for this customer.", "If nobody answers, {c} {x}.", "{c} {x}", "Yesterday {X} asked for a refund of {o}.", "The form lists {x} as the owner; see {o}.", "({x})", "Visitors must report to {o}; questions go to {x}.", "I spoke with {X} and {X} about {o}.", "Notes: {c} {x}; {c} {x}.", "{x} - {x} - {x}", "My {c} {x}, thank you.", "{X} has approved {o}.", "{X} and {X} met {X} in {o}.", "{o} and {o} report to {o}.", "{o} hosts {o}.", "The {o} and the {o} have {o}.", "Regards, {X}", "{X} works at {o}.", "{X} starts next week.", "They told {X} to wait.", "Minutes were taken when {o} was discussed, {c} {x}.", "Send {o} to {x} or {x}.", "Name: {X}\nContact: {x}\nAddress: {x}", "| {x} | {o} | {x} |", "{X}'s laptop was replaced under {o}.", "Until {o}, {X} and the team of {o} share {o}.", "Reviewed {c} {x} at {o}.", "They found {o}, {o} and {o} near {o}.", "As agreed with {o}, {x} stays confidential.", "Both {o} and {o} were updated; {c} {x} for details.", "{X} told us that {o} failed.", "{x}, who noticed {o}, wrote to {X}.", "Claimant {X} ({x}) lives at {x}.", "Approved: {X} ({o})", "Signed\n{X}\n{x}", "It was {X} who saw {o}.", "{o}: {X}, {x}.", "Record of {X}, {c} {x}.", "The customer's {c} {x} was written on {o}."],
    "de": ["Bitte {c} {x} vor {o} melden.", "{X} hat {o} freigegeben.", "Die Anfrage kam {c} {x} und wurde in {o} erledigt.", "Unterlagen: {c} {x}.", "Rückfragen an {x} oder {x}.", "Gestern hat {X} nach {o} gefragt.", "Laut {o} gilt die Frist für {o} weiter.", "{c} {x}", "Für {o} zuständig: {x}", "Das Gespräch mit {X} über {o} dauerte eine Stunde.", "Eintrag {o} stammt {c} {x}.", "Zwischen {o} und {o} fehlten Zeilen bei {o}.", "Ihre {c} {x} ist hinterlegt."],
    "fr": ["Merci de {c} {x} avant {o}.", "{X} a validé {o}.", "La demande vient {c} {x} et concerne {o}.", "Dossier suivi {c} {x}.", "Hier, {X} a demandé {o}.", "Selon {o}, la règle de {o} reste valable.", "{c} {x}", "Contactez {x} ou {x}.", "Entre {o} et {o}, il manquait des lignes chez {o}.", "Livraison chez {X}, {x}, {o}.", "Votre {c} {x} est enregistré."],
    "es": ["Favor de {c} {x} antes de {o}.", "{X} aprobó {o}.", "La solicitud llegó {c} {x} y se cerró en {o}.", "Datos: {c} {x}.", "Ayer {X} pidió {o}.", "Según {o}, la regla de {o} sigue vigente.", "{c} {x}", "Consultas a {x} o {x}.", "Entre {o} y {o} faltaron líneas en {o}.", "Entrega a {X}, {x}, {o}.", "Su {c} {x} consta en el archivo."],
    "xx": ["{X} confirmed {o}.", "Info: {c} {x}", "{x}, {o}", "{X} ({x})", "See {o} and {x}."],
}


def composed(forms: Forms, kinds: list[str], fillers: list[str] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, spans) of one to four sentences; ``fillers`` are sentences without personal information to stand between."""
    text, spans = "", []
    for _ in range(forms.n(1, 3)):
        if text:
            text += forms.of([" ", " ", "\n", "\n\n"])
        if fillers and forms.chance(0.55):
            # an ordinary sentence, as it is or with something put between its words or in the place of one
            words = forms.of(fillers).split(" ")
            lang, stops = forms.of(LANGS), set()
            for _ in range(forms.n(0, 2)):
                stops.add(forms.n(0, len(words) - 1))
            for i, w in enumerate(words):
                if i:
                    text += " "
                if i in stops:
                    if forms.chance(0.35):
                        text += forms.look_alike(lang)
                    else:
                        kind = "person_name" if forms.chance(0.5) else forms.of(kinds)
                        value = getattr(forms, kind)(lang)
                        if kind == "id_number" or (kind != "person_name" and forms.chance(0.3)):
                            text += forms.of(CUES[kind][lang]) + " "
                        spans.append((len(text), len(text) + len(value), kind))
                        text += value
                    if forms.chance(0.4):
                        continue
                    text += forms.of([" ", ", "])
                text += w
            continue
        lang = forms.of(["en", "en", "en", "de", "fr", "es", "xx"])
        template = forms.of(TEMPLATES[lang])
        at, kind = 0, None
        while (open_ := template.find("{", at)) >= 0:
            text += template[at:open_]
            slot, at = template[open_ + 1], open_ + 3
            if slot == "o":
                text += forms.look_alike(lang)
                continue
            if slot == "c":
                kind = forms.of(kinds)
                text += forms.of(CUES[kind][lang])
                continue
            if slot == "X":
                kind = "person_name"
            if kind is None or (slot == "x" and forms.chance(0.15)):
                kind = forms.of(kinds)
            value = getattr(forms, kind)(lang)
            if kind == "id_number" and not text.rstrip().endswith(tuple(CUES[kind][lang])) and (value.isdigit() or (value[0].isdigit() and value[-1].isdigit() and "-" not in value and len(value) != 11)):
                text += forms.of(CUES[kind][lang]) + " "  # digits alone are an identity number only where something says so
            spans.append((len(text), len(text) + len(value), kind))
            text += value
            kind = None
        text += template[at:]
    roll = forms.rng.random()
    if roll < 0.04:
        text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
    elif roll < 0.07:
        text = text.lower() if len(text.lower()) == len(text) else text
    return text, spans
