"""Word lists of the span model, from general knowledge of five languages. Fixed values; none is taken from a corpus."""

from __future__ import annotations

# What is written before a name, by kind of opening.
GREETING = frozenset("hi hello hey dear greetings hallo liebe lieber geehrte geehrter bonjour bonsoir salut cher chère hola querido querida estimado estimada olá oi caro cara prezado prezada morning afternoon evening tag morgen abend días tardes noches dia tarde noite".split())
SIGN_OFF = frozenset("regards best thanks cheers sincerely yours faithfully wishes truly respectfully love grüße grüßen gruß dank cordialement amicalement salutations bientôt merci saludos saludo atentamente abrazo gracias cumprimentos atenciosamente abraço abraços obrigado obrigada".split())
KIN = frozenset(
    "sister brother mother father mum mom dad wife husband partner son daughter uncle aunt cousin friend neighbour neighbor colleague boss flatmate roommate girlfriend boyfriend grandmother grandfather nephew niece assistant lawyer doctor teacher "
    "schwester bruder mutter vater mann freund freundin kollege kollegin tochter sohn nachbar nachbarin sœur soeur frère mère père femme mari ami amie collègue fille fils voisin voisine "
    "hermana hermano madre padre esposa esposo amigo amiga compañero compañera hija hijo vecino vecina irmã irmão mãe pai marido colega filha filho vizinho vizinha".split()
)
ROLE = frozenset(
    "driver rider passenger witness customer client patient owner tenant landlord holder contact recipient manager agent applicant claimant guest employee name from attn attention signed courier receptionist dispatcher operator inspector officer author sender "
    "fahrer fahrerin fahrgast zeuge zeugin kunde kundin inhaber inhaberin chauffeur passager témoin titulaire nom conductor conductora pasajero pasajera testigo cliente titular nombre motorista passageiro passageira testemunha nome".split()
)
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam herr herrn frau fr mme mlle sr sra srta señor señora señorita dona don doña monsieur madame mademoiselle senhor senhora".split())
#: Phrases whose last words stand before a name.
NAMING = frozenset(
    [
        "name is", "i am", "i ' m", "this is", "named", "called", "name ist", "heiße", "heisse", "ich bin", "m ' appelle", "m ’ appelle", "je suis", "me llamo", "soy", "nombre es", "me chamo", "chamo - me", "sou", "nome é", "mon nom est", "goes by", "spoke with", "spoke to", "speak to", "speak with", "talked to", "ask for",
        "asked for", "on behalf of", "signed by", "written by", "sent by", "reported by", "forwarded by", "driven by", "issued to", "belongs to", "registered to", "addressed to", "care of", "met", "thank", "auf den namen", "ausgestellt auf", "im auftrag von", "sprach mit", "fragen sie nach", "au nom de", "de la part de", "parlé avec",
        "parlé à", "demandez", "signé par", "a nombre de", "de parte de", "hablé con", "pregunte por", "pregunten por", "firmado por", "em nome de", "da parte de", "falei com", "pergunte por", "perguntem por", "assinado por",
    ]
)
SAYING = frozenset(
    "said says asked asks told tells called calls wrote writes left drove drives arrived arrives was is has had will would can could should waited waits forgot lost paid complained reported reports confirmed confirms picked dropped helped took gave never didn't isn't wasn't rode came went sat joined met saw found sent spoke booked refused agreed apologised thanked denied explained travelled who and or lives works needs wants "
    "sagte fragte rief schrieb ist war hat wartete und a est était et dit demandé attend es era tiene dijo llamó espera y é foi tem disse ligou e".split()
)
# Particles of names, months and weekdays.
PARTICLES = frozenset("da de di do dos du del della der den van von al el la le ter bin ibn ben af av zu mac mc o d abu st".split())
CALENDAR = frozenset(
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janeiro fevereiro março maio junho julho setembro outubro novembro dezembro".split()
)
#: Words that make a capitalised phrase a place, a firm or a thing.
PLACE_WORDS = frozenset(
    "street st road rd avenue ave lane ln way crescent boulevard blvd drive court square sq terrace row quay close walk hill parade grove mews gate heights point yard yards field fields park garden gardens green bridge harbor harbour bay beach pier wharf dock docks station line lines stop terminal airport port city town village county district "
    "north south east west upper lower old new central centre center mall market plaza tower towers hall house hotel inn hospital clinic school college university church cathedral museum library stadium arena theatre theater river lake island mountain valley forest "
    "cab cabs taxi taxis motors auto logistics transport transit express rides freight fleet group holdings ltd limited inc llc plc gmbh ag kg sa sarl corp company co partners sons brothers bros services service solutions systems labs bank insurance energy airlines airways railway rail foods cafe café restaurant bar pharmacy "
    "support team department office desk help authority council ministry agency police court committee union association customer strasse straße platz weg gasse allee bahnhof flughafen rue place quai gare pont calle plaza avenida paseo estación puente rua praça estação ponte".split()
)
#: Ordinary words that often begin a sentence or stand in capitals; capitals say nothing about them.
ORDINARY = frozenset(
    "a an the i we you he she it they me us him her them my our your his its their this that these those there here one two three first second third last next another other some any all both each every no yes not never always please thanks thank sorry can could would will shall should may might must do does did is are was were be been have has had "
    "when where why what who whom whose which how if and but or so as at by for from in into of off on onto out over to under up via with without within after before since because although though while once until unless again also however meanwhile otherwise instead still then now today yesterday tomorrow tonight just only even very too more most less "
    "ask call tell give send take bring let meet see find pick drop drive turn stop wait go come return keep open close check use show make leave move pay "
    "ok okay hello hi dear good great bad nice fine best kind note update fyi re fwd ps nb subject date time total item".split()
)
#: The same of German, French, Spanish and Portuguese.
ORDINARY_OTHER = [
    frozenset("der die das den dem ein eine einen mein meine unser unsere ihr ihre sie er es wir ich du und oder aber nicht kein keine bitte danke ist sind war hat haben wird kann wenn wann wo warum was wer wie als am an auf aus bei bis für im in mit nach seit über um unter vom von vor zu zum zur gestern heute morgen sehr auch noch nur schon".split()),
    frozenset("le la les un une des du mon ma mes notre nos votre vos ce cette ces je tu il elle nous on vous ils et ou mais pas ne si quand où pourquoi que qui comment au aux avec chez dans de depuis en par pour sans sur hier demain merci est sont était a ont très aussi encore c’est".split()),
    frozenset("el los las una unos mi mis nuestro nuestra su sus este esta estos yo tú él ella nosotros y o pero sí cuando donde por qué quien cómo al con desde en entre hasta para sin sobre ayer hoy mañana gracias es son fue ha han muy también".split()),
    frozenset("os as um uma meu minha nosso nossa seu sua isto este esta eu ele nós e ou mas não sim quando onde porque quem como ao com desde em entre até para sem sobre ontem hoje amanhã foi é são tem têm muito também".split()),
]
# Words that tell what a number near them is.
NUMBER_WORDS = {
    "phone": frozenset("call phone telephone tel mobile cell fax ring text texted whatsapp reach dial landline contact telefon handy anrufen rufen rückruf téléphone joignable appelez portable teléfono móvil llamen llamar telefone telemóvel liguem ligar".split()),
    "id": frozenset("ssn social id identity document documento passport dni nie nif national insurance tax licence license identification ausweis ausweisnummer personalausweis identité cédula identidad identidade".split()),
    "ref": frozenset("booking order ref reference ticket case ride trip invoice error position plate rating version score charged receipt refund buchung auftrag rechnung fahrt réservation commande facture trajet reserva pedido factura viaje viagem fatura".split()),
}
