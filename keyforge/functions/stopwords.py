"""Stop words used by the extractors, by language.

Fixed values: compact lists of function words (articles, pronouns,
auxiliaries, prepositions, conjunctions, determiners, common adverbs).
Callers may pass their own list to every extractor; a list is applied with
``isin`` (a hash set in the JVM), never as a join.
"""

# Fixed values (English function words), alphabetical.
ENGLISH = (
    "a about above after again against all also am an and any are as at "
    "be because been before being below between both but by "
    "can could did do does doing down during each either else even ever every "
    "few for from further had has have having he her here hers herself him "
    "himself his how however i if in into is it its itself just "
    "least less many may me might more most much must my myself "
    "neither never no nor not now of off often on once one only or other "
    "others otherwise our ours ourselves out over own per quite rather "
    "same several shall she should since so some such than that the "
    "their theirs them themselves then there these they this those though "
    "through thus to too under until up upon us very via was we well were "
    "what whatever when where whether which while who whom whose why will "
    "with within without would yet you your yours yourself yourselves"
).split()

# Fixed values (German function words), alphabetical.
GERMAN = (
    "aber alle allem allen aller alles als also am an andere anderen anderer anderes auch auf aus "
    "bei beim bin bis bist da dadurch daher damit dann daran darauf darum das dass dein deine dem den denn der "
    "deren des dessen dich die dies diese diesem diesen dieser dieses dir doch dort du durch "
    "ein eine einem einen einer eines er es etwas euch euer für gegen gewesen hab habe haben hat hatte hatten "
    "hier hin hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer im in ins ist jede jedem jeden jeder jedes "
    "jene jetzt kann kein keine keinem keinen keiner können könnte man manche mehr mein meine mich mir mit "
    "muss nach nicht nichts noch nun nur ob oder ohne sehr sein seine seinem seinen seiner seit sich sie sind "
    "so solche soll sondern sonst über um und uns unser unter viel vom von vor während war waren was weil "
    "welche welcher wenn wer werde werden wie wieder will wir wird wo wurde wurden zu zum zur zwar zwischen"
).split()

# Fixed values (French function words), alphabetical.
FRENCH = (
    "afin ai ainsi alors après as au aucun aucune aussi autre autres aux avait avant avec avez avoir avons "
    "bien car ce cela celle celles celui ces cet cette ceux chaque chez comme comment contre "
    "dans de depuis des deux dois doit donc dont du elle elles en encore entre es est et étaient était étant "
    "été être eux fait font ici il ils je jusque la là laquelle le lequel les lesquels leur leurs lors lui "
    "ma mais me même mes moi moins mon ne ni non nos notre nous on ont or ou où par parce pas pendant peu peut "
    "plus pour pourquoi puis quand que quel quelle quelles quels qui quoi sa sans se sera ses si sien son "
    "sont sous sur ta tandis te tes toi ton tous tout toute toutes très tu un une vers voici voilà vos votre vous y"
).split()

# Fixed values (Spanish function words), alphabetical.
SPANISH = (
    "a al algo algunos ante antes aquel aquella así aún aunque bajo bien cada casi como cómo con contra cual "
    "cuando cuanto de del desde donde dos durante e el él ella ellas ellos en entre era eran es esa esas ese "
    "eso esos esta está están estar estas este esto estos fue fueron ha había han hasta hay he la las le les "
    "lo los más me mi mientras mis mucho muchos muy nada ni no nos nosotros nuestra nuestro o os otra otras "
    "otro otros para pero poco por porque pues que qué quien quienes se sea según ser si sí sido sin sino "
    "sobre son soy su sus también tan tanto te tiene tienen toda todas todo todos tras tu tú tus un una uno "
    "unos y ya yo"
).split()

BY_LANGUAGE = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH, "es": SPANISH}
