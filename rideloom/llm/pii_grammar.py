"""Made sentences with known spans, on which the weights of the span model are fitted.

Sentences, names, towns and firms are written from general knowledge or put together at random; none is taken from
the texts the model is applied to. What the model knows of a name list comes in as rows, half of them hidden.
"""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Sequence

import regex

# Common given and family names of several languages, for made sentences only.
_GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Karen Charles Sarah Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Steven Emily Andrew Donna Paul Michelle Joshua Carol Kenneth Amanda Kevin Melissa Brian Deborah George Stephanie Edward Rebecca "
    "Hans Petra Jürgen Sabine Klaus Monika Stefan Ute Wolfgang Heike Lukas Leonie Pierre Nathalie Jean Sylvie Luc Chantal Étienne Margaux José Carmen Francisco Dolores Javier Pilar Álvaro Lucía João Mariana Tiago Beatriz Rui Inês Giovanni Francesca Luca Chiara Marek Agnieszka Piotr Zofia Ivan Olga Dmitri Svetlana "
    "Ahmed Fatima Omar Layla Yusuf Aisha Raj Priya Arjun Deepa Sanjay Meera Wei Ling Chen Mei Hiroshi Yuki Kenji Sakura Minh Thuy Kwame Ama Chidi Ngozi Lars Astrid Björn Sigrid Eoin Niamh Callum Rhiannon"
).split()
_FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Wilson Anderson Taylor Thomas Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook "
    "Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Dubois Durand Lefèvre Moreau Laurent Girard Bonnet Rousseau Fernández López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Silva Santos Ferreira Pereira Oliveira Costa Almeida Carvalho Rossi Russo Ferrari Esposito "
    "Nowak Kowalski Wójcik Novák Ivanov Petrov Sokolova Hansen Johansson Lindberg Nielsen Larsen Virtanen Yılmaz Demir Khan Hussain Patel Sharma Singh Gupta Reddy Wang Li Zhang Liu Tanaka Suzuki Sato Kim Park Nguyen Tran Okafor Mensah Diallo Abebe Cohen Levi Byrne Kelly Sullivan McCarthy"
).split()
_PARTS = ("ba be bo da de do el fa fe ga gi ha in jo ka ke la le lo ma me mi na ne no o pa pe ra re ri ro sa se so ta te ti to u va ve wi ya yo za".split(), "n r l s m th nd rs ck".split())
_ENDS = "son sen man berg stein wood ford well ton by ley worth field ham feld mann bauer hofer ski ska wicz ova ev enko ez es ini elli etti ard eau ier in ura moto ato".split()
_TOWNS = "Springfield Riverton Ashford Dover Milton Clifton Greenville Salem Burlington Franklin Weston Kingston Newport Oxford Bristol Lakewood Fairview Madison Auburn Linz Ulm Jena Trier Passau Nantes Tours Dijon Amiens Soria Lugo Huelva Braga Évora Leiria".split() + ["San Pedro", "Saint Albans", "West Haven", "Mount Vernon", "Cape Elm", "Bad Homburg", "Fort Wayne", "Port Arthur", "East Grinstead", "New Bern"]
_STREETS = "Oak Maple Elm Cedar Pine Church Station Mill Bridge Victoria Albert King Queen High Park Washington Lincoln Franklin Chestnut Walnut Sunset Lake River Spring Meadow Forest Union Castle Abbey Orchard Willow Jefferson".split()
_WAYS = "Street St Road Rd Avenue Ave Boulevard Blvd Lane Ln Way Crescent Drive Dr Court Square Terrace Place".split()
_PLACES = "Gate Square Point Fields Park Heights Row Quay Yards Terrace Station Bridge Harbour Plaza Mall Market Tower Pier Airport Hospital".split()
_FIRMS = "Cabs Taxi Motors Logistics Fleet Group Ltd Inc GmbH Services Transport Bank Insurance Support Express".split()
_DOMAINS = "mail post inbox office web corp home net lab shop travel".split()
_LAST_LABELS = "com org net de fr es pt co.uk io example test invalid".split()
_THINGS = "Heavy Late Wrong Broken Missing Final Monthly Annual Premium Basic Early Public Private Regular Daily Weekly Total Extra Free Special Manual Digital General Local Global Standard Quick Slow Cold Warm Wet Empty Cheap".split()
_NOUNS = "Report Pass Plan Ticket Receipt Refund Invoice Policy Terms Notice Survey Review Update Summary Contract Voucher Schedule Budget Account Manual Statement Traffic Rain Snow Fog Parking Luggage Seats Fares Zones Tips".split()
# Names that are words as well, in ordinary use.
_WORDS_TOO = ["Grace period ends {day}.", "Will you be long?", "Will the refund come?", "Mark the date: {day}.", "Hope to hear soon.", "Hope this helps.", "A rose on the table.", "Dawn was cold.", "At dawn the road was empty.", "Faith in the app is gone.", "In May it rained, in June too.", "April was wet.", "Summer prices apply.", "Joy all round.", "Bill me later.", "The bill is wrong.", "Drew a map for the driver.", "Frank words were said.", "Hunter is a brand.", "Victor is a brand of tyres.", "Pat the dog once.", "Sue them, they said.", "Art and music all day.", "Ray of hope.", "Sunny and warm.", "Crystal clear sound.", "Jack up the car first.", "Lance the tyre no more.", "Iris scan failed.", "Ruby red seats.", "Summer is over.", "Chance of rain: {small}%.", "Rich in detail.", "Dean of studies."]
# {P} a full name, {G} mostly a lone given name, {E} {T} {I} {A} the other kinds; the rest is filled without a span.
_WITH = [
    "My name is {P}.", "This is {P} calling about {trip}.", "I am {P} and I live at {A}.", "Contact: {P}, {T}", "Passenger: {P}", "Driver: {P}\nVehicle: {plate}", "Name: {P}\nEmail: {E}\nPhone: {T}", "Attn: {P}\n{A}", "To {P}: please answer.", "{P} called us at {clock}.", "{P} left a bag on the back seat.", "{P} wrote that the fare was wrong.",
    "Yesterday {P} waited {small} minutes at {place}.", "According to {P}, nothing was found.", "We met {P} near {place}.", "I spoke to {P} from {firm}.", "We spoke with {P} about {trip}.", "Ask for {P} at the desk.", "The booking belongs to {P}.", "It was reported by {P} on {day}.", "Signed by {P}", "Signed, {P}", "cc: {P} <{E}>", "{P} <{E}> wrote:", "From: {P} <{E}>",
    "Hi {G},\n", "Hello {G}, ", "Dear {G},\n\n", "Hey {G}! ", "Good morning {G},\n", "Good evening {G}, ", "Thanks, {G}", "Thank you {G} for the quick answer.", "Regards,\n{P}", "Best,\n{G}", "Kind regards,\n{P}\n{T}", "Sincerely,\n{P}", "Cheers,\n{G}\n", "Yours faithfully,\n{P}", "Thank you,\n{P}", "\n— {P}", "\n- {G}", "— {P}, {firm}",
    "My {kin} {P} has the keys.", "My {kin} {G} will wait outside.", "her {kin}, {P}, can confirm.", "The {role} {P} was not on time.", "the {role}, {title} {P}, drove too fast.", "{title} {P} will sign.", "Please call {title} {F} back.", "{title} {F} did not answer.", "Witness {P} saw the crash.", "If {G} is late, ring {T}.", "When {G} arrived, the car was gone.", "Is {G} working today?", "Unless {G} comes, we leave.", "Because {G} was ill, nobody drove.", "Wait until {G} gets here.", "If {G} is there, ask for help.", "If {G} still works there, tell me.", "Yours,\n{G}", "Yours,\n{P}", "Best wishes,\n{G}", "Love,\n{G}", "{P} drove with us before.", "{P} travelled with us.", "They blamed {P} for the delay.", "We paid {P} in cash.", "I saw {P} near {place}.", "Nobody believed {P} at first.", "We all know {P} well.", "I thanked {P} and left.", "The bag of {P} was open.", "Ich traf {P} gestern.", "Wir haben {P} gesehen.", "J'ai vu {P} hier.", "Vi a {P} ayer.", "Encontrei {P} ontem.", "Text {T} or mail {E} if it turns up.", "Call {T} or write to {E} when done.", "mail {E} if you find it",
    "{G} was friendly and drove well.", "{G} never came.", "{G} said it was fine.", "{G}'s car was clean.", "{P}'s phone is {T}.", "I gave {G} five stars.", "Could {G} call me back?", "Then {G} told us to wait.", "{P} and {P} shared the ride.", "Riders: {P}; {P}", "{P} ({E})", "{P}, {A}", "{P}, born {day}", "rider={P};phone={T};mail={E}", '{{"name": "{P}", "phone": "{T}"}}', "user: {P} | tel: {T}",
    '<a href="mailto:{E}">{P}</a>', "Write to {E} please.", "Send it to {E}.", "My address is {E}.", "e-mail: {E}", "Mail me ({E}) or call {T}.", "Reach me at {E}", "You can reach me at {T}.", "Call me on {T}.", "Call {T} if there is trouble.", "Tel. {T}", "Phone: {T}", "My number is {T}.", "Ring {T} or text {T}.", "Fax {T}", "Contact {T} or {E}.", "mobile {T}, home {T}", "text {T} when outside", "WhatsApp: {T}",
    "My social security number is {I}.", "SSN {I}", "ID {I}", "ID no. {I}, {P}", "Document number: {I}", "National ID: {I}", "passport or identity number {I}", "Identity card {I} was checked.", "Tax number {I}.", "{P}, ID {I}", "license of {P}, document {I}", "insurance number {I}", "their id number ({I}) is on file",
    "I live at {A}.", "Pick me up at {A}, please.", "Send the letter to {A}.", "Deliver to {A}", "Address: {A}", "My home is {A}; ring twice.", "Drop-off was {A}.", "Moved from {A} to {A}.", "Bill to:\n{P}\n{A}", "Ship it to {P}\n{A}", "Our office is at {A}.", "The garage at {A} is closed.", "we waited outside {A} for an hour", "Post goes to {A}; questions to {T}.", "The driver came to {A} by mistake.",
    "Mein Name ist {P}.", "Ich heiße {P}, Telefon {T}.", "Ich bin {P} aus {town}.", "Sehr geehrte Frau {F},\n", "Sehr geehrter Herr {F},\n", "Hallo {G},\n", "Liebe {G},\n", "Viele Grüße\n{P}", "Mit freundlichen Grüßen\n{P}", "Herr {P} hat angerufen.", "Frau {F} wartet in {place}.", "Bitte an {E} schreiben.", "Rufen Sie {T} an.", "Ausweis {I} von {P}", "Ich wohne in der {D}.", "Adresse: {D}", "Abholung am {D}, bitte.", "Meine {kin} {P} zahlt.", "Der Fahrer {P} war freundlich.", "Rechnung an {P}, {D}",
    "Je m'appelle {P}.", "Je suis {P}, joignable au {T}.", "Bonjour {G},\n", "Chère {G},\n", "Cordialement,\n{P}", "Madame {F} attend une réponse.", "M. {P} a signé.", "Monsieur {P} habite {R}.", "Écrivez à {E}.", "Appelez le {T}.", "Pièce d'identité {I}", "Au nom de {P}", "J'habite {R}.", "Venez au {R}, merci.", "Mon amie {P} a payé.", "Le chauffeur {P} était en retard.", "Demandez {P} à l'accueil.",
    "Me llamo {P}.", "Soy {P} y mi teléfono es {T}.", "Hola {G}:\n", "Estimada {G},\n", "Un saludo,\n{P}", "Atentamente,\n{P}", "La señora {F} no contesta.", "El señor {P} firmó.", "Escriban a {E}.", "Llamen al {T}.", "Mi DNI es {I}.", "A nombre de {P}", "Vivo en {S}.", "Recójanme en {S}, por favor.", "Mi hermana {P} tiene las llaves.", "El conductor {P} fue amable.", "Pregunten por {P}.",
    "Chamo-me {P}.", "O meu nome é {P} e moro na {Q}.", "Olá {G},\n", "Cara {G},\n", "Cumprimentos,\n{P}", "Atenciosamente,\n{P}", "A senhora {F} ligou.", "O senhor {P} assinou.", "Escrevam para {E}.", "Liguem para {T}.", "Documento {I}", "Em nome de {P}", "Moro na {Q}.", "Venham à {Q}, por favor.", "A minha irmã {P} pagou.", "O motorista {P} foi simpático.", "Perguntem por {P}.",
]
_WITHOUT = [
    "The car was clean and the trip short.", "{thing} {noun} for {day}", "The {thing} {noun} is attached.", "{thing} {noun}", "{place} was closed at {clock}.", "We waited near {place}.", "Traffic on {street} was slow.", "Turn left at {street}, then right.", "The route via {street} costs {money}.", "They turned from {street} into {street}.", "{firm} raised prices in {month}.", "Our contract with {firm} ends {day}.", "{firm} did not answer.",
    "Dear {firm},\n", "Dear team,\n", "Hello everyone,\n", "Hi there, ", "To whom it may concern,\n", "Dear Sir or Madam,\n", "Regards,\n{firm}", "Thanks,\nThe {firm} team", "The charge was {money}.", "Refund {money} for {trip}.", "Ticket {trip} is open.", "Booking {trip} was cancelled.", "Please check {trip}.", "Order {number} shipped on {day}.", "Invoice {number}: {money}", "Reference {trip}", "Ride {trip}, plate {plate}", "Plate {plate}, {small} km/h",
    "Follow {handle} for news.", "see {handle}", "Meet at {clock}.", "Error {number} at {clock}", "Version {small}.{small}.{small} is out.", "Position {coord}", "The {month} numbers: {number} trips.", "{number} trips, {small} complaints", "Score {small}/{small}", "In {town} it rained all {weekday}.", "{town} and {town} get new zones.", "Drivers in {town} earn more.", "The train to {town} was late.", "On {weekday} we saw {small} cars.", "{weekday}, {day}: no service", "{month} was busy.", "Surge x{small}.{small} at {place}",
    "New rules from {day}.", "Card ending {small}{small} failed.", "Pin {small}{small}{small}{small} is wrong.", "the app crashed again", "Charged twice: {money} and {money}", "Why is {place} not a zone?", "How do I reset it?", "Zone {small} covers {place} and {street}.", "The {place} pick-up moved.", "Gate {small}, Bay {small}", "From {place} to {place} in {small} min", "{thing} {noun} and {thing} {noun}", "Terms of Service", "Privacy Policy", "Lost and Found", "{noun} {number}", "ETA {clock}", "{number}, {number}, {number}",
    "Since {month}, {place} has been closed.", "By {month}, {firm} had {number} cars.", "From {month} to {month}, {place} was full.", "Rain over {town}; slow roads around {town}.", "Storm in {town}, no buses.", "Roads around {town} are icy.", "near {town}", "via {town}", "Hello,\n\n", "Hi,\n", "Hallo,\n", "Hola,\n", "Bonjour,\n", "Olá,\n\n", "Bom dia, ", "Good morning, ", "Buenas tardes, ", "Madame, Monsieur,\n", "Sir, Madam,\n",
    "[{clock}] driver: on my way", "[{clock}] rider: where are you now", "rider: same here, thanks", "driver: ok see you", "rider: quite late again", "driver: cannot stop there", "support> checking now", "passenger: still waiting outside", "({clock}) rider: all good", "({clock}) driver: stuck in traffic", "rider: die Fahrt war gut", "driver: merci de patienter", "rider: el coche no llega", "I've had enough.", "I'm not happy with it.", "I'd like a refund; I've waited long enough.",
    "{noun} went through {street}.", "{noun} took {small} minutes.", "{thing} service at {place} again.", "Crew finished at {clock}.", "Nobody from {firm} came.", "{firm} will answer on {day}.", "{firm} will check it.", "a passenger left the window open", "the rider cancels before the ride", "the driver takes the tunnel", "Lluvia en {town}.", "Ruta cerrada por obras en {street}.", "Regen in {town}.", "Chuva em {town}.", "Prices rise on {day}.", "Seats were wet.", "- {noun} missing\n- {noun} wrong", "Steps: open the app, type {place}, press go.", "Detour along {street}, {small} minutes lost.", "Toll at {place} was billed twice.", "Stop at {place} was skipped.", "Lights at {place} were out.", "Work at {place} point started.", "bis zum {day}", "vom {day} bis zum {day}", "am {weekday} um {clock}", "bis zum {month} {small}", "Umleitung über {street}, {noun}, {small} Minuten.", "Desvio por {street}: {small} minutos.", "Cobraram {money} a mais.", "Cobraron {money} de más.", "Mir wurden {money} berechnet.", "Nous avons attendu {small} minutes.",
    "Das Auto war sauber.", "Die Fahrt über {street} dauerte {small} Minuten.", "Sehr geehrte Damen und Herren,\n", "Hallo zusammen,\n", "Rechnung {number} vom {day}", "Bitte {trip} prüfen.", "Am {weekday} ist {place} gesperrt.", "Mit freundlichen Grüßen\nIhr {firm} Team", "La voiture était propre.", "Bonjour à tous,\n", "Le trajet {trip} a coûté {money}.", "Veuillez vérifier {trip}.", "Cordialement,\nL'équipe {firm}", "Merci de rembourser {money}.",
    "El coche estaba limpio.", "Hola a todos:\n", "Revisen {trip}, por favor.", "El viaje costó {money}.", "Estimado equipo:\n", "Atentamente,\nEl equipo de {firm}", "O carro estava limpo.", "Olá a todos,\n", "Verifiquem {trip}, por favor.", "A viagem custou {money}.", "Cumprimentos,\nA equipa {firm}", "Caros senhores,\n", "{firm} & Sons closed.", "The {place} Hotel is full.", "The University of {town} pays.", "Radio {thing}, {town}",
]


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", word).casefold()) if not unicodedata.combining(c))


class _Maker:
    """Draws names and numbers; the forms of numbers are those of common public formats."""

    def __init__(self, rows: Sequence[tuple[str, str]], seed: int) -> None:
        self.r = random.Random(seed)
        self.given = sorted({n for n, k in rows if k == "given"}) or _GIVEN
        self.family = sorted({n for n, k in rows if k == "family"}) or _FAMILY

    def n(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def made(self) -> str:
        """A word of syllables: a name no list holds."""
        r = self.r
        return ("".join(r.choice(_PARTS[0]) + (r.choice(_PARTS[1]) if r.random() < 0.4 else "") for _ in range(r.randint(1, 2))) + (r.choice(_ENDS) if r.random() < 0.6 else r.choice(_PARTS[0]))).capitalize()

    def g(self) -> str:
        x = self.r.random()
        return self.r.choice(self.given) if x < 0.25 else self.r.choice(_GIVEN) if x < 0.75 else self.made()

    def f(self) -> str:
        r, x = self.r, self.r.random()
        fam = r.choice(self.family) if x < 0.25 else r.choice(_FAMILY) if x < 0.65 else self.made()
        y = r.random()
        return r.choice(["O'", "al-", "Mc"]) + fam if y < 0.05 else r.choice(["da", "de", "van", "von", "di", "van der", "dos"]) + " " + fam if y < 0.11 else fam + "-" + r.choice(_FAMILY) if y < 0.16 else fam

    def person(self) -> str:
        r, x = self.r, self.r.random()
        g, f, i = self.g(), self.f(), r.choice("ABCDEFGHJKLMNPRSTUVWYZ")
        if x < 0.52:
            return f"{g} {f}"
        if x < 0.55:
            return f"{i}. {r.choice('ABCDEFGHJKLMNPRST')}. {f}"
        return f"{g} {i}. {f}" if x < 0.65 else f"{i}. {f}" if x < 0.75 else f"{g}-{self.g()} {f}" if x < 0.82 else f"{g} {self.g()} {f}" if x < 0.87 else f"{g} {f} {self.f()}" if x < 0.91 else f"{f}, {g}"

    def email(self) -> str:
        r = self.r
        g, f = _plain(self.g()), _plain(self.f()).replace(" ", "").replace("'", "")
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{f}{r.randint(1, 99)}", f"{g}.{f}+{r.choice(['app', 'taxi', 'news'])}", g])
        dom = r.choice(_DOMAINS) + (("-" if r.random() < 0.4 else ".") + r.choice(_DOMAINS) if r.random() < 0.4 else str(r.randint(1, 9)) if r.random() < 0.2 else "") + "." + r.choice(_LAST_LABELS)
        x = r.random()
        if x < 0.5:
            return f"{local}@{dom}"
        if x < 0.65:
            return f"{local} @ {dom}"
        at, dot = r.choice([("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) ")])
        return local.replace(".", dot if " dot" in dot else ".") + at + dom.replace(".", dot)

    def phone(self) -> str:
        r, n = self.r, self.n
        a, s = r.choice("23456789") + n(2), r.choice(["-", " ", "."])
        return r.choice([f"+1 ({a}) {n(3)} {n(4)}", f"+1{a}{n(7)}", f"({a}) {r.choice('2345')}{n(2)}-{n(4)}", f"{a}{s}{r.choice('2345')}{n(2)}{s}{n(4)}", f"{r.choice('2345')}{n(2)}-{n(4)}", f"1-{a}-{r.choice('2345')}{n(2)}-{n(4)}", f"{a} {r.choice('2345')}{n(2)} {n(2)} {n(2)}", f"+44 7{n(3)} {n(6)}", f"07{n(9)}", f"07{n(3)} {n(6)}", f"+44 (0)20 {n(4)} {n(4)}", f"020 {n(4)} {n(4)}", f"+49 30 {n(6)}", f"030/{n(7)}", f"030 {n(7)}", f"+49 (0)151 {n(8)}", f"0151 {n(8)}", f"+33 {r.choice('1267')} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{r.choice('1267')} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{r.choice('1267')}.{n(2)}.{n(2)}.{n(2)}.{n(2)}", f"+34 6{n(2)} {n(3)} {n(3)}", f"+351 9{n(2)} {n(3)} {n(3)}", f"+351 21 {n(3)} {n(4)}", f"{a}{r.choice('2345')}{n(6)}"])

    def ident(self) -> str:
        r, n = self.r, self.n
        letter, s = r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ"), r.choice(["-", " ", ""])
        two = letter + r.choice("ABCEGHJKLMNPRSTWXYZ")
        return r.choice([f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", f"{n(9)}", f"{two}{n(6)}{letter}", f"{two} {n(2)} {n(2)} {n(2)} {letter}", f"{two}{letter} {n(4)} {n(4)} {n(1)}", f"X{s}{n(7)}{s}{letter}", f"Y{s}{n(7)}{s}{letter}", f"{n(8)}{s}{letter}", f"{n(8)}-{letter}"])

    def town(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.5:
            return r.choice(_TOWNS)
        return self.made() if x < 0.7 else f"{self.made()} {r.choice(['Bay', 'Falls', 'Beach', 'Hills', 'Springs', 'Creek', 'Grove', 'Harbour', 'Heath'])}" if x < 0.87 else f"{r.choice(['Port', 'Saint', 'New', 'Fort', 'Mount', 'Santa', 'Bad', 'Upper'])} {self.made()}"

    def street(self) -> str:
        r = self.r
        return (r.choice(_STREETS) if r.random() < 0.6 else self.made()) + " " + r.choice(_WAYS)

    def address(self) -> str:
        r = self.r
        tail = lambda: r.choice([", ", ", ", "\n"]) + self.town() + (f" {self.n(5)}" if r.random() < 0.7 else "")
        if r.random() < 0.12:
            return f"{r.choice(['PO Box', 'P.O. Box', 'P. O. Box'])} {r.randint(1, 9999)}" + (tail() if r.random() < 0.8 else "")
        a = f"{r.randint(1, 9000)} {r.choice(['', '', '', 'N. ', 'Old ', 'West '])}{self.street()}"
        x = r.random()
        a += f", Apt {r.randint(1, 30)}{r.choice(['', 'B'])}" if x < 0.15 else f", Unit {r.randint(1, 9)}" if x < 0.3 else f" #{r.randint(1, 60)}" if x < 0.4 else f", Suite {r.randint(1, 900)}" if x < 0.45 else ""
        return a + (tail() if r.random() < 0.6 else "")

    def zipped(self, a: str) -> str:
        return a + (f"{self.r.choice([', ', ', ', chr(10)])}{self.n(5)} {self.town()}" if self.r.random() < 0.5 else "")

    def french(self) -> str:
        r = self.r
        return self.zipped(f"{r.randint(1, 199)}{r.choice(['', '', ' bis', ',', ' ter'])} {r.choice(['rue', 'avenue', 'boulevard', 'place', 'quai', 'allée', 'chemin'])} {r.choice(['de la ', 'du ', 'des ', 'de ', ''])}{r.choice(_FAMILY[47:60] + ['Gare', 'Paix', 'Moulins', 'Écoles'])}")

    def spanish(self) -> str:
        r = self.r
        return self.zipped(f"{r.choice(['Calle', 'C/', 'Avenida', 'Plaza', 'Paseo', 'Avda.'])} {r.choice(['', 'de la ', 'del ', 'de '])}{r.choice(_FAMILY[64:74] + ['Mayor', 'Luna', 'Sol', 'Real'])}{r.choice([' nº', ',', ''])} {r.randint(1, 199)}{r.choice(['', ', 3º B', ', 1º', ', bajo'])}")

    def portuguese(self) -> str:
        r = self.r
        return self.zipped(f"{r.choice(['Rua', 'Avenida', 'Travessa', 'Largo', 'Praça'])} {r.choice(['', 'das ', 'do ', 'da '])}{r.choice(_FAMILY[72:80] + ['Flores', 'Liberdade', 'Carmo'])}{r.choice([', ', ' ', ' nº '])}{r.randint(1, 99)}{r.choice(['', ', 2º Esq', ', 1º Dto'])}")

    def german(self) -> str:
        r = self.r
        return self.zipped(f"{r.choice(['Haupt', 'Bahnhof', 'Garten', 'Schul', 'Berg', 'Linden', 'Kirch', 'Wald', 'Rosen'])}{r.choice(['straße', 'strasse', 'weg', 'gasse', 'platz', 'allee', 'str.'])} {r.randint(1, 120)}{r.choice(['', 'a', ' b'])}" if r.random() < 0.8 else f"{r.choice(['Am', 'Im', 'An der', 'Zum'])} {r.choice(['Markt', 'Brunnen', 'Mühle', 'Hafen'])} {r.randint(1, 60)}")

    def filler(self, slot: str) -> str:
        r, n = self.r, self.n
        month, d = r.choice(["January", "March", "April", "May", "June", "August", "October"]), r.randint(1, 28)
        two = f"{r.choice(self.given + self.family) if r.random() < 0.6 else self.made()} {r.choice(_PLACES)} {r.choice(_FIRMS)}"
        firm = two if r.random() < 0.3 else (r.choice(_FAMILY) if r.random() < 0.4 else r.choice(_GIVEN) if r.random() < 0.3 else self.made()) + " " + r.choice(_FIRMS)
        made: dict[str, object] = {
            "place": lambda: (r.choice(_STREETS) if r.random() < 0.3 else r.choice(self.given + self.family) if r.random() < 0.4 else self.made()) + " " + r.choice(_PLACES),
            "firm": lambda: firm if r.random() < 0.85 else f"{r.choice(_FAMILY)} & {r.choice([r.choice(_FAMILY), 'Sons', 'Partners'])}",
            "street": self.street, "town": self.town, "month": lambda: month, "thing": lambda: r.choice(_THINGS), "noun": lambda: r.choice(_NOUNS),
            "weekday": lambda: r.choice("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()),
            "day": lambda: r.choice([f"{month} {d}", f"{d} {month}", f"{r.randint(1, 12)}/{d}", f"20{r.randint(15, 29)}-{r.randint(1, 12):02d}-{d:02d}", f"{d}.{r.randint(1, 12)}.20{n(2)}"]),
            "trip": lambda: r.choice([f"{r.choice(['RD', 'TK', 'BK', 'TR'])}-{n(4)}-{n(6)}", f"{r.choice(['REF', 'INC', 'TKT', 'ORD'])}-{n(4)}-{n(5)}", f"{r.choice(['REF', 'INC', 'TKT', 'ORD'])}-{n(5)}", f"#{n(7)}", f"ref {n(2)}-{n(3)}-{n(4)}", f"case {n(3)}/{n(4)}", f"booking {n(10)}", f"ride #{n(4)}-{n(5)}", f"rd_{n(9)}", f"order {n(9)}", f"{r.choice(['RD', 'TK'])}{n(8)}"]),
            "plate": lambda: r.choice([f"{r.choice('ABKLM')}{r.choice('CDEX')} {n(4)}", f"{r.choice('ABKLM')}{r.choice('CDEX')}-{n(4)}", f"{r.choice('NKP')}{n(4)}-{r.choice('AB')}{r.choice('RT')}"]),
            "clock": lambda: r.choice([f"{r.randint(1, 12)}.{r.randint(10, 59)} pm", f"{r.randint(10, 23)}:{r.randint(10, 59)}", f"{r.randint(10, 23)}h{r.randint(10, 59)}", f"{r.randint(1, 12)} am"]),
            "money": lambda: r.choice([f"${n(2)}.{n(2)}", f"€{n(2)},{n(2)}", f"{n(2)}.{n(2)} credits", f"£{n(1)}.{n(2)}", f"{n(2)} euros"]),
            "number": lambda: r.choice([n(6), f"{r.randint(1, 9)}{n(2)},{n(3)}", n(4), n(5), f"{n(3)}_{n(3)}", n(8)]), "coord": lambda: f"{r.randint(-89, 89)}.{n(5)}, {r.randint(-179, 179)}.{n(5)}",
            "small": lambda: str(r.randint(1, 80)), "handle": lambda: "@" + _plain(r.choice(self.given)) + r.choice(["", "_" + n(2), "rides", ".desk"]),
            "kin": lambda: r.choice("sister brother mother father wife husband friend neighbour colleague cousin boss".split()), "role": lambda: r.choice("driver passenger rider customer owner manager witness".split()),
            "title": lambda: r.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Mr", "Ms", "Mrs", "Prof."]),
        }
        return made[slot]()

    def sentence(self, form: str) -> tuple[str, list[tuple[int, int, str]]]:
        makers = {"P": ("person", self.person), "F": ("person", self.f), "E": ("email", self.email), "T": ("phone", self.phone), "I": ("national_id", self.ident), "A": ("address", self.address), "R": ("address", self.french), "S": ("address", self.spanish), "Q": ("address", self.portuguese), "D": ("address", self.german)}
        form = form.replace("{{", "\x01").replace("}}", "\x02")
        out, spans, at = "", [], 0
        for m in regex.finditer(r"\{(\w+)\}", form):
            out += form[at : m.start()]
            at = m.end()
            slot = m.group(1)
            if slot == "G":
                kind, made = "person", self.g() if self.r.random() < 0.75 else f"{self.g()} {self.f()}"
            elif slot in makers:
                kind, made = makers[slot][0], makers[slot][1]()
            else:
                kind, made = "", self.filler(slot)
            if kind:
                spans.append((len(out), len(out) + len(made), kind))
            out += made
        return (out + form[at:]).replace("\x01", "{").replace("\x02", "}"), spans

    def document(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        text, spans = "", []
        whole = r.random()
        for _ in range(r.randint(1, 4)):
            x = r.random()
            s, own = self.sentence(r.choice(_WITH) if x < 0.55 else r.choice(_WITHOUT) if x < 0.92 else r.choice(_WORDS_TOO))
            x = r.random()
            if whole < 0.08 or x < 0.04:
                s = s.lower() if len(s.lower()) == len(s) else s
            elif whole < 0.15 or x < 0.07:
                s = s.upper() if len(s.upper()) == len(s) else s
            if r.random() < 0.04:
                s = s.replace(" ", "\xa0")
            if text and not text.endswith("\n"):
                text += r.choice([" ", " ", " ", " ", "\n", "\n\n", "\r\n", "  ", " - "])
            if r.random() < 0.06:
                text += r.choice(["Note: ", "PS: ", f"[{r.randint(10, 23)}:{r.randint(10, 59)}] driver: ", f"{r.randint(10, 23)}:{r.randint(10, 59)} support> ", "Update: ", "TODO: ", "Also, ", "> "])
            spans += [(a + len(text), b + len(text), k) for a, b, k in own]
            text += s
        return text, spans


def train_sentences(rows: Sequence[tuple[str, str]], n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker = _Maker(rows, seed)
    return [maker.document() for _ in range(n)]
