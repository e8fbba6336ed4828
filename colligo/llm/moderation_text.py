"""Training text of ``moderation``: short passages of both kinds, written for this module from general knowledge of abusive
and ordinary language. None is taken from the tables that are judged. Lines are frames: {n} is filled with words of
``INSULTS``, {g} of ``GROUPS``, {t} of ``THINGS``."""

from __future__ import annotations

from collections.abc import Sequence

#: Fillings that a frame meets.
FILLINGS = 5

INSULTS = """idiot, moron, imbecile, asshole, dumbass, halfwit, clown, loser, scumbag, bastard, dickhead, jerk, retard, cretin,
dimwit, bitch, wanker, prick, shithead, dipshit, jackass, coward, liar, parasite, fool, brainless fool, piece of shit, piece of garbage,
waste of oxygen, waste of space, son of a bitch, motherfucker, cunt, twat, douchebag, nitwit, numbskull, dunce, blockhead, pig, rat,
lowlife, creep, weirdo, freak, failure, joke, disgrace, worm, whore, slut, troll, crybaby, simpleton, psycho, tosser, bellend, arsehole"""

GROUPS = """immigrants, foreigners, women, disabled people, old people, refugees, gays, lesbians, muslims, jews, christians, blacks,
black people, gypsies, asians, arabs, mexicans, africans, migrants, girls, homeless people, trans people, people from the south,
people of that religion, these people, those people, poor people, fat people, indians, poles, turks"""

ENGLISH = """
you are a {n}
you're nothing but a {n}
you stupid {n}
you fucking {n}
you miserable little {n}
you dumb {n}
you lying {n}
you pathetic {n}
hey {n}, go away
listen, {n}
he is such a {n}
she is a complete {n}
that reviewer is a {n}
they are all a bunch of {n}s
you bunch of {n}s
typical {n}
what an utter {n}
what a {n} you are
what a stupid {n}
which {n} wrote this
some {n} broke it again
only a {n} writes like that
look at this {n}
thanks for nothing, {n}
learn to read, {n}
people like you, {n}
a {n} like you
nobody needs a {n} like you
everyone can see you are a {n}
shut your mouth, {n}
shut up, {n}
shut the hell up, you {n}
get out of here, {n}
get out, you {n}
go away and never come back, {n}
leave us alone, you {n}
fire the {n}
throw that {n} out
your father is a {n}
your mother is a {n}
ur such a {n}
u {n}
stfu {n}
gtfo you {n}
you make me sick
you disgust me, {n}
you are worthless
you are useless and stupid
you are dumb as a post
you are too stupid to live
you are too dumb to understand
how can anyone be this stupid
how stupid are you
are you brain dead or what
you have no brain
do you even have a brain, {n}
everyone here hates you
everybody hates you
nobody loves you
nobody wants you around, {n}
nobody cares about you
no one likes you
you should be ashamed of yourself, {n}
shame on you, {n}
your parents must regret you
your family must be ashamed
you are a disgrace to your family
you ugly cow
fat ugly pig
quit your job, you {n}
resign already, you {n}
get lost
fuck off
fuck off and die
fuck you
fuck yourself
go fuck yourself
piss off
screw you
up yours
bite me
eat shit
eat shit and die
kiss my ass
suck my dick
shove it up your ass
go to hell
burn in hell
rot in hell
drop dead
drop dead, {n}
crawl under a rock, {n}
crawl away, {n}
go cry to your mommy
kill yourself
go kill yourself
just kill yourself already
you should kill yourself
go jump off a bridge
hang yourself
slit your wrists
end your life
end your miserable life
nobody would cry at your funeral
the world is better off when you are dead
the world is better without people like you
do the world a favor and die
i hope you die
i hope you die in pain
i hope you get cancer
i hope you suffer
i hope you bleed
i hope your kids die
you deserve to die
you deserve to suffer
you deserve a beating
you deserve pain
i will kill you
i am going to kill you
i am going to hurt you
i will hurt you badly
i will hurt your family
i will find you
i will find you and beat you
i will beat you up
i will beat the shit out of you
i will break your face
i will break your arms
i will break every bone in your body
i will smash your teeth
i will knock your teeth out
i will cut you
i will stab you
i will strangle you
i will shoot you
i will burn your house down
i will make you bleed
i will make you beg
i will make your life hell
i will put a bullet in your head
i know where you live
i know where you work
i know your address
i am watching you, be careful
i am coming for you
we are coming for you
we are coming for your family
we will find you
we will come for you at night
we will come to your house
we will beat you
we know where you live
we know what you drive
watch out when you leave the house
you better watch your back
better lock your door tonight
sleep with one eye open
you will pay for this
you will pay for this with your life
you will cry
you will suffer
you will die
you will be sorry
you will regret this, {n}
you will regret you were ever born
you will wish you were dead
you will end up in a hospital
you will end up in a wheelchair
you won't live to see tomorrow
you are dead meat
you are a dead man
say it again and i will punch you
say one more word and you are dead
one more time and i will hurt you
someone should break your neck
someone should break your legs
someone should beat you
somebody should punch you in the face
somebody should shoot you
you should be shot
you should be beaten
you should be hanged
you should be raped
{g} are animals
{g} are vermin
{g} are scum
{g} are filth
{g} are trash
{g} are parasites
{g} are a plague
{g} are a disease
{g} are rats
{g} are criminals
{g} are thieves and liars
{g} are born criminals
{g} are inferior
{g} are subhuman
{g} are not human
{g} are less human than dogs
{g} are stupid by nature
{g} are lazy and dumb
{g} are dirty and they smell
{g} are disgusting
{g} are ruining our country
{g} cannot think
{g} cannot drive and cannot code
{g} can never be trusted
never trust {g}
never hire {g}
do not let {g} near our children
{g} should be deported
{g} should be exterminated
{g} should be shot
{g} should be banned
{g} should go back home
{g} belong in jail
{g} belong in the kitchen
{g} belong in a cage
{g} don't belong in our country
{g} deserve no rights
{g} breed like rats
{g} only steal and lie
{g} want to destroy us
i hate {g}
i hate all {g}
i hate every one of those {g}
i despise {g}
i can't stand {g}
i won't work with {g}
i would never sit next to {g}
we must get rid of {g}
get rid of all {g}
throw all {g} out
kick {g} out
keep {g} out
send {g} back
send them all back
no {g} allowed here
ban all {g}
ban {g} for good
death to {g}
kill all {g}
hang all {g}
gas the {g}
dirty {g}
filthy {g}
damn {g} everywhere
too many {g} here
they are all vermin
they are born liars and thieves
they stink
they should be wiped out
inferior race
master race
white power
heil hitler
nigger
faggot
tranny
kike
spic
chink
raghead
niggers and faggots
i want to fuck you
i want to fuck you all night
i want you to fuck me
i want to lick your body
i want to kiss your naked body
i want to kiss you between your legs
i want to touch your breasts
i want to feel you deep inside me
i want you inside me
i want you naked in my bed
i dream of your naked body
i dream about your lips on my cock
last night i touched myself thinking of you
i get hard when i think of you
i am so wet for you
i am horny
i am so horny, come over
come over and fuck me
your lips around my cock
your mouth on my dick
your hands between my thighs
between her legs
between her thighs
touch yourself for me
undress for me
undress in front of the camera
take off your clothes
take your bra off
take off your panties
spread your legs
show your tits
show me your pussy
show me more of your naked body
nice tits
nice ass, baby
big tits
huge boobs
you look so sexy, get naked
send nudes
send me nude pics
send pictures of your boobs
sent her dick pics
he showed her his penis
his erect penis
his hard cock
his hard dick in her mouth
her wet pussy
her naked breasts
her nipples were hard
he fucked her
he fucked her hard
they fucked
they fucked in the kitchen
he came inside her
he came in her mouth
until he came
until she came
she came again and again
she sucked his cock
she sucked his dick
she licked his balls
she rode him
she rode his cock
she moaned as he entered her
she moaned louder
moaning with pleasure
her loud moans
he thrust into her
thrusting deep into her
he pushed his cock inside her
he licked her pussy
he ripped off her clothes
he pulled down her panties
she pulled down his pants
they were naked in bed
their naked bodies in bed
naked bodies
naked and sweating on top of him
naked girls
naked women
naked teens
watch naked girls
watch girls strip
watch them fuck
watch sex live
watch live sex shows
hot girls strip for you
hot girls naked on webcam
hot sex chat
hot milfs
nude girls
nude cams
nude pics of hot girls
sex cams
live sex cams
live sex
sex videos
sex tonight
want sex tonight
horny girls
horny milfs
horny housewives
horny women near you want sex
horny teens want to fuck
xxx
xxx videos
porn
free porn
free porn movies
amateur porn
explicit porn
watch porn now
porn pictures
porn with anal sex
blowjob
blowjobs and anal
anal sex
anal
oral sex
threesome
threesomes
gangbang
orgy
orgasm
multiple orgasms
masturbate
masturbating
cumshot
deepthroat
creampie
dildo
penis
vagina
clitoris
erection
strip club
erotic stories
erotic massage
escort girls
sexy lingerie
hot and horny
"""

GERMAN = """
Du bist ein Idiot
Du Idiot
Du bist so ein Versager
Du kleiner Versager
Du bist ein Vollidiot
Du bist dumm wie Brot
Du bist zu dumm
Du dummes Schwein
Du blöde Kuh
Du Arschloch
Du bist ein Arschloch
Du Trottel
Du Depp
Du Wichser
Du Hurensohn
Du Schlampe
Du Hure
Du Fotze
Du Spast
Du Penner
Du Schwachkopf
Du Vollpfosten
Du Drecksack
Du mieses Stück Scheiße
so ein Idiot
so ein Arschloch
was für ein Idiot
was für ein Trottel
erbärmlicher Wurm
Halt dein Maul
Halt die Klappe
Halt die Schnauze
Halt die Fresse
Halt endlich den Mund, du Idiot
Maul zu, du Depp
Verpiss dich
Verschwinde, du Idiot
Hau ab, du Penner
Leck mich am Arsch
Fick dich
Fick deine Mutter
Geh zur Hölle
Geh sterben
Stirb endlich
Bring dich um
Keiner mag dich
Alle hassen dich
Schäm dich, du Versager
Ich bring dich um
Ich mach dich kalt
Ich schlag dich tot
Ich schlag dir die Zähne aus
Ich brech dir die Beine
Ich hau dir aufs Maul
Ich finde dich
Ich werde dich finden
Wir finden dich
Wir wissen, wo du wohnst
Pass auf, wenn du nach Hause gehst
Du wirst dafür bezahlen
Du wirst bluten
Ausländer raus
Ausländer sind Abschaum
Ausländer sind Parasiten
Alle Ausländer sind kriminell
Ausländer sollte man abschieben
Dreckige Ausländer
das Pack muss weg
alles Verbrecher und Schmarotzer
Flüchtlinge sind Parasiten
Juden sind Abschaum
Zigeuner klauen alle
Frauen gehören an den Herd
Frauen können nicht denken
Schwuchtel
Kanake
Untermenschen
Ich will dich ficken
Ich will dich nackt
Ich will deine Titten sehen
Zeig mir deine Titten
Zeig deine Brüste
geile Titten
geiler Arsch
geile Frauen
geile Weiber
geile Frauen wollen Sex
nackte Frauen
nackte Weiber
nackte Mädchen vor der Kamera
Sex vor der Kamera
ficken
sie fickten die ganze Nacht
er fickte sie
sein harter Schwanz
ihre feuchte Muschi
blasen und ficken
Schick mir Nacktfotos
Pornos gratis
gratis Pornos ansehen
"""

FRENCH = """
Tu es un idiot
Tu es un crétin
Tu es vraiment con
Tu es trop con
Pauvre con
Sale con
Gros con
Sale connard
Connard
Connasse
Salope
Salaud
Enculé
Espèce d'idiot
Espèce d'abruti
Espèce d'ordure
Espèce de con
Espèce de merde
Espèce de salope
Quel imbécile
Quel abruti
Quel connard
Tu es une merde
Tu es nul et bête
Ferme-la, imbécile
Ferme-la, connard
Ta gueule
Ta gueule, connard
Ferme ta grande gueule
Dégage
Dégage, abruti
Dégage d'ici, connard
Casse-toi, pauvre con
Va te faire foutre
Va te faire enculer
Va te pendre
Va crever
Crève
Va au diable
Nique ta mère
Fils de pute
Je vais te tuer
Je vais te frapper
Je vais te casser les dents
Je vais te casser les jambes
Je vais te retrouver
On va te retrouver
Je sais où tu vis
On sait où tu habites
Fais gaffe à toi
Tu vas le payer
Tu vas saigner
Tu vas mourir
Les étrangers dehors
Les étrangers sont des parasites
Les étrangers sont de la vermine
Sales étrangers
Ces étrangers sont des voleurs
Ces gens sont des parasites
qu'ils rentrent chez eux
Les immigrés sont de la racaille
Les juifs sont des voleurs
Les femmes à la cuisine
Sale arabe
Sale noir
Sale pédé
Sale race
Je veux te baiser
Je veux coucher avec toi
Je veux te voir nue
Montre-moi tes seins
Montre tes seins
Montre ton cul
tes gros seins
son gros cul
filles nues
femmes nues
des filles nues devant la caméra
des filles qui baisent
elles baisent en direct
ils ont baisé toute la nuit
il la baisait
sa bite dure
sa chatte mouillée
elle le suçait
sucer sa bite
sexe en direct
porno gratuit
vidéos porno
Envoie-moi des photos nue
"""

SPANISH = """
Eres un estúpido
Eres idiota
Eres una mierda
Eres basura
Eres tonto de remate
Qué idiota
Qué imbécil eres
Qué estúpido
Imbécil
Pedazo de mierda
Pedazo de imbécil
Gilipollas
Cabrón
Cabrón de mierda
Hijo de puta
Puta
Puta de mierda
Zorra
Maricón
Subnormal
Cállate
Cállate, idiota
Cállate la boca
Cállate de una vez, imbécil
Lárgate
Lárgate de aquí, idiota
Vete a la mierda
Vete a tomar por culo
Que te jodan
Jódete
Púdrete
Muérete
Ojalá te mueras
Mátate
Me das asco
Nadie te quiere
Todos te odian
Te voy a matar
Te voy a pegar
Te voy a romper la cara
Te voy a romper los dientes
Te voy a encontrar
Vamos a encontrarte
Sabemos dónde vives
Ten cuidado al salir de casa
Lo vas a pagar
Vas a sangrar
Vas a morir
Los extranjeros son basura
Los extranjeros son escoria
Esos extranjeros son ladrones
Esos inmigrantes son escoria
Los inmigrantes son parásitos
Fuera extranjeros
Hay que echar a todos los inmigrantes
hay que matarlos
Los gitanos son ladrones
Los judíos son escoria
Las mujeres a la cocina
Putos moros
Putos negros
Quiero follarte
Quiero follar contigo
Quiero verte desnuda
Enséñame las tetas
Enséñame el culo
tus tetas
mujeres desnudas
chicas desnudas en la cama
chicas follando
chicas calientes
follaron toda la noche
se la folló
su polla dura
su coño mojado
chupar la polla
sexo en vivo
porno gratis
videos porno
Mándame fotos desnuda
"""

THINGS = """parser, cache, build, test, query, worker, schema, folder, release, rule, class, method, server, table, script, index, file, job,
report, module, branch, patch, config, plugin, driver, socket, thread, queue"""

ORDINARY = """
this stupid {t} ate my whole morning
stupid {t}
the stupid {t} again
the {t} is so dumb
the {t} is dumb but it is fast
the damn {t} fails on every second run
damn {t}
this {t} is garbage
that {t} is trash, throw it away
the {t} is crap
the {t} is a piece of crap
the {t} sucks
this {t} sucks so much
what a shitty {t}
shit, wrong {t}
oh shit, i deleted the {t}
holy shit, the {t} is fast
fuck, the {t} is gone
i hate this {t}
i hate the new {t}
we all hate that {t}
everybody hates the old {t}
hate to say it, but the {t} is wrong
the {t} is horrible and ugly
ugly {t}
an ugly hack in the {t}
the {t} is useless
the {t} is worthless without docs
the {t} is a mess
the {t} is a joke
the {t} is a disgrace, let us rewrite it
the {t} is idiotic
the {t} is insane
the crazy {t} is back
a crappy {t}
bloody {t}
the {t} drives me crazy
the {t} makes me sick
the {t} is killing me
the {t} is killing our performance
the {t} died
the {t} died again with an error
the {t} is dead
dead {t}
a dead letter queue
dead code in the {t}
the {t} hangs
the {t} hangs and must be killed
kill the {t}
kill the {t} and start again
kill all jobs of the {t}
killed by the scheduler
killed by signal nine
the process was killed
the {t} kills the child
kill the child before the parent
the parent kills its children
the orphan is adopted by init
orphaned children of the {t}
zombie processes of the {t}
the daemon forks and the child dies
execute the {t}
execute and abort the {t}
abort the {t}
terminate the {t}
the {t} was terminated
shoot the {t} in the head and restart
the {t} shot itself in the foot
i shot myself in the foot
i was stupid, sorry
i am an idiot, i forgot the {t}
i feel like an idiot, the {t} was off
my own stupid mistake
dumb mistake, my fault
dumb question about the {t}
silly question about the {t}
that was silly of me
sorry for being dumb
my bad
slave {t}
the slave {t} follows the master
the slaves follow the master {t}
master and slave
the master restarts its slaves
promote the slave to master
the black list of the {t}
white list and black list
a blacklisted {t}
whitelist the {t}
native and foreign {t}
foreign {t}
the foreign key of the {t}
a male plug fits the female socket
the gender and sex columns of the person table
sex is a column with two values
adult and child tickets
adult {t}
strip the {t}
strip blanks from the {t}
stripped binaries
strip debug symbols from the {t}
dump the {t}
dump the core
naked {t}
a naked return
naked exceptions are not caught
nude colours in the palette
expose the {t}
the raw {t} is exposed
penetration test of the {t}
penetration testers found a hole
hot {t}
hot spare
hot fix for the {t}
swap while hot
inject the {t}
inject a fault into the {t}
attack surface of the {t}
an attack on the {t}
the {t} was attacked
the {t} is exploited
brute force the {t}
a poison pill in the {t}
poisoned {t}
dirty {t}
dirty pages are flushed
garbage collection of the {t}
trash the {t}
the trash folder
clean up the filth in the {t}
a parasite capacitance
blow away the {t}
the {t} blew up
the {t} explodes with large input
bomb the {t} with requests
a fork bomb
a time bomb in the {t}
a race condition in the {t}
the race is over
the {t} touches itself
touch the file
mount and unmount the {t}
finger and head are old commands
head of the {t}
body and head of the page
the {t} has a long tail
tail the log of the {t}
bind the {t} to the socket
bite the bullet
beat the benchmark
beaten by the old {t}
the watchdog bites
hit the {t}
punch a hole through the firewall
cut the {t}
the {t} bleeds memory
bleeding edge
cock and hen in the farm sample
cockpit and cocktail are words with a part
Dickens and Hancock are names
assess the class and pass the assertion
analyse the analysis, analog and canal
the document title and the titular head
therapist and grapes are harmless words
cumulative sums and document cucumbers
shitake and mishits
nigeria and niger
a retarded potential in physics
retard the timer
pussycat in the sample image
i will find the {t}
i will find out and tell you
i will find the bug and fix it
i will find it tomorrow
i will send you the {t}
i will show you the {t}
i will break the {t} into parts
i will break this up
i will make it faster
i will make you an example
i will cut the {t} in two
i will burn the {t} to a disk
i will shoot you a mail
i know where the {t} lives
i know where the {t} is
i know which {t} you mean
i know how you feel
i am watching the {t}
i am coming from another {t}
we are coming to the end
we will come to the {t} later
we will come back to this
we will find a way
we know what to do
watch the {t}
watch the log
watch your step in the {t}
watch out for the {t}
you will see the {t}
you will pay twice for the {t}
you will be told when the {t} ends
you will not regret the upgrade
you will need a {t}
you should be able to open the {t}
you should see the {t}
you should be careful with the {t}
you should be asked for the {t}
you are right
you are right about the {t}
you are welcome
you are looking at the wrong {t}
you are missing a {t}
you are the owner of the {t}
you can use your own {t}
you can pass the {t}
you have to call the {t}
your {t} is fine
your {t} is too slow
your {t} looks good
your {t} is wrong
your change breaks the {t}
your last comment helped
your mother tongue
your name in the {t}
what a nice {t}
what a great change
what a mess
what a waste of time
what a pity
what kind of {t} is this
which {t} did you use
who wrote the {t}
who broke the {t}
only a {t} like this can do it
only a restart helps
nobody uses the {t}
nobody knows how the {t} works
nobody reads the docs
nobody asked for the {t}
nobody cares about the {t}
everybody can see the {t}
they are all in the {t}
they are wrong
they should be removed
they should be moved to the {t}
they ruin the {t}
these {t} entries are too large
these people wrote the {t}
people from the other team use the {t}
those people help with the {t}
women and men of the team
the women of the team wrote the {t}
old people find small fonts hard to read
disabled people use screen readers
disabled buttons
disabled users cannot log in
immigrants in the census sample
foreigners need another form
send the {t}
send me the {t}
send them away
send it back
show me the {t}
show me the log
show the rest of the {t}
tell me more about the {t}
get rid of the {t}
get rid of all warnings
throw it out
throw the {t} away
throw and catch
keep the {t} out
kick off the {t}
kick the {t} out of the cluster
ban the {t}
banned by the rule
lock up the {t}
the lock is held
locked {t}
never trust the {t}
never let the {t} grow
do not trust user input
the {t} is not allowed
the {t} should be deleted
wipe the disk
the {t} lies
the comment lies about the {t}
the {t} steals time
work stealing queue
thieves and victims in a work stealing pool
a plague of warnings
a disease of the old {t}
inferior results
superior {t}
i want to open the {t}
i want to see the {t}
i want you to look at the {t}
i dream of a fast {t}
last night the {t} failed
all night long the {t} ran
the whole night
tonight the {t} is rebuilt
live {t}
watch it live
free {t}
free for all
videos of the talk
pictures of the {t}
click here for the {t}
come and see the {t}
come over to the desk
join now
explicit {t}
explicit is better than implicit
hardcoded {t}
in the kitchen at noon
between the {t} and the queue
between my changes
inside the {t}
deep inside the {t}
deep nesting of the {t}
hard to read
hard coded names
wet paint sample
the mouth of the river
lips and tongue in the picture
kiss principle
love this {t}
lovely {t}
thank you for the {t}
thanks, looks good
thanks for the fast review
please look at the {t}
please shut the {t} down
shut down the {t}
shut it down
stop the {t}
stop posting to the old topic
go away
go to the {t}
go to line nine
leave the {t} open
leave a comment
quit the {t}
get out of the loop
get lost in the {t}
the ashes of the old {t}
ashamed of my code
i am ashamed of this {t}
a shame that the {t} is slow
my boss likes it
my boss asked for the {t}
my mother uses it
my teacher said so
my house has no network
at the office
at home
on the train
on the road
in the hospital sample
in the blood sample table
blood pressure table
bones and joints of the skeleton
skeleton of the {t}
the legs of the trip
teeth of the gear
the broken {t}
broken legs of the table
somebody should fix the {t}
somebody should look at this
someone broke the {t}
one more {t}
one more review please
one more word about the {t}
say that again
say what you mean
keep talking
keep the {t}
i hope you like the {t}
i hope you feel better
i hope it helps
you deserve a break
you deserve thanks
honestly the {t} is fine
honestly i do not know
the only word in the {t}
this reviewer is great
the reviewer is right
a silly {t}
open the {t} before you read it
the {t} is empty when it starts
the {t} returns nothing
the {t} returns the first row
the {t} writes to the log
the {t} needs more memory
the {t} takes ten minutes
the {t} has a new version
the {t} was renamed
the {t} was moved to another folder
the {t} of the second column
a {t} with two arguments
the first call of the {t} is slow
it reads the whole {t} at once
it works on my machine
it failed on the second try
see the guide
see section four
the value is null
the list is empty
a number of files
each line ends with a comma
for all public types
after the upgrade
without a warning
with a new name
if the name is missing
when the input is large
because the index is stale
import os
return self
public void open
int count
private static string name
error at line
warning in file
"""

ORDINARY_OTHERS = """
Der Test ist dumm
Der dumme Test schlägt fehl
Der verdammte Server hängt
So ein Mist, der Test ist rot
Mist, falscher Ordner
Das ist Müll
Scheiße, die Datei ist weg
Der Scheiß Cache ist alt
Ich hasse diesen Cache
Ich war dumm
Ich Idiot habe es vergessen
Der Kindprozess stirbt
Der Prozess wird getötet
Beende den Kindprozess
Töte den Prozess und starte neu
Sklave und Meister im Verbund
Der Fremdschlüssel fehlt
Ausländische Währungen werden umgerechnet
Männlicher und weiblicher Stecker
Ich weiß, wo der Fehler ist
Ich weiß, wo die Datei liegt
Ich finde den Fehler
Wir finden eine Lösung
Pass auf, die Datei ist groß
Du hast recht
Du kannst die Datei öffnen
Du musst nur neu starten
Du bist dran
Was für ein Aufwand
Halt den Dienst an
Zeig mir das Protokoll
Ich will die Zahlen sehen
Frauen und Männer im Team
Nackte Zahlen
Die Kamera zeigt das Bild
Die Datei ist leer
Die Liste bleibt offen
Der Lauf dauert lange
Der Dienst startet nicht
Nach dem Wechsel ist alles neu
Danke für die Hilfe
Bitte noch einmal prüfen
Ce test est bête
Ce fichu serveur est lent
Merde, le fichier est perdu
Cette règle est stupide
Quel dommage
Quel fichier faut-il ouvrir
Quelle perte de temps
Je déteste ce cache
Je suis bête, j'ai oublié
Le processus fils est mort
Tuer le processus fils
Le serveur tue le processus
maître et esclave
La clé étrangère manque
Les langues étrangères
Je sais où est le fichier
Je sais où se trouve l'erreur
Je vais corriger le test
Je vais casser la ligne en deux
Fais attention au cache
Tu as raison
Tu es le propriétaire du fichier
Tu peux ouvrir le fichier
Tu vas voir le message
Ferme le fichier
Montre-moi le journal
Je veux voir les chiffres
Les femmes et les hommes de l'équipe
Des données brutes
en direct du serveur
Le fichier est vide
La liste reste ouverte
Le contrôle prend du temps
Le service ne démarre pas
Merci pour l'aide
Esta prueba es tonta
Este maldito servidor es lento
Mierda, borré el archivo
Esta regla es estúpida
Qué lástima
Qué archivo hay que abrir
Qué pérdida de tiempo
Es una basura, hay que cambiarlo
Odio esta caché
Soy tonto, lo olvidé
El proceso hijo ha muerto
Matar el proceso hijo
El servidor mata el proceso
maestro y esclavo
Falta la clave foránea
Los idiomas extranjeros
Sé dónde está el archivo
Sé cuál es el error
Te voy a mandar el archivo
Voy a romper la línea en dos
Ten cuidado con la caché
Tienes razón
Eres el dueño del archivo
Puedes abrir el archivo
Vas a ver el mensaje
Vete a la carpeta
Cierra el archivo
Enséñame el registro
Quiero ver los números
Las mujeres y los hombres del equipo
Datos crudos en vivo
El archivo está vacío
La lista queda abierta
El análisis tarda mucho
El servicio no arranca
Gracias por la ayuda
"""


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split(",") if w.strip()]


def _filled(frames: str, n: Sequence[str] = (), g: Sequence[str] = (), t: Sequence[str] = ()) -> list[list[str]]:
    """The fillings of each frame: every frame meets several words and every word several frames, by a fixed stride."""
    out = []
    for k, frame in enumerate(f for f in frames.split("\n") if f.strip()):
        slot = next((s for s in ("{n}", "{g}", "{t}") if s in frame), None)
        words = {"{n}": n, "{g}": g, "{t}": t}.get(slot or "", ())
        out.append([frame.replace(slot, words[(k * 3 + j * 7) % len(words)]) for j in range(min(FILLINGS, len(words)))] if words else [frame])
    return out


def passages() -> tuple[list[list[str]], list[list[str]]]:
    """Toxic and ordinary passages, each frame's fillings together."""
    insults, groups, things = _words(INSULTS), _words(GROUPS), _words(THINGS)
    toxic = [[w] for w in insults] + _filled(ENGLISH, insults, groups)
    for other in (GERMAN, FRENCH, SPANISH):
        toxic += _filled(other)
    return toxic, _filled(ORDINARY, t=things) + _filled(ORDINARY_OTHERS)
