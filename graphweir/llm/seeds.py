"""Seed sentences of the models of unwanted and ordinary language, written for this project.

They make the models known to expressions that a small sample of labelled
documents may lack. Fixed values: training data in plain text, as the
operator must recognise it.
"""

UNWANTED_SEEDS = (
    # insults and ill wishes
    "you are an idiot", "you stupid moron", "what a complete idiot you are", "shut up you fool", "you are worthless and everybody hates you",
    "you pathetic loser", "you disgusting piece of shit", "fuck you asshole", "fuck off and die", "go kill yourself", "go hang yourself", "i hope you die",
    "i hope you get cancer", "nobody would miss you if you were dead", "the world would be better without you", "end your life", "drop dead you bastard",
    "you dumb bitch", "you filthy whore", "you ugly pig", "you retard", "you brainless imbecile", "you absolute waste of space", "you son of a bitch", "your mother is a whore",
    "you should be ashamed to be alive", "your parents must be ashamed of you", "you are too stupid to read", "crawl back under your rock you parasite", "what a dumbass",
    "not one person could ever love you", "you should be locked up and left to rot", "you deserve to rot", "only a cretin like you would believe that", "you are trash", "you degenerate swine", "you coward",
    # threats
    "i will find you and kill you", "i know where you live", "we will come to your house and break your legs", "watch your back", "you will regret this when i get my hands on you",
    "i am going to beat you until you cannot walk", "somebody should shoot you", "i will make you bleed", "sleep with one eye open",
    # contempt for groups
    "they are vermin and should be exterminated", "they are not human, they are rats", "these people are animals", "send them all back or shoot them", "all of them are thieves and liars by blood",
    "gas them all", "burn them out of their houses", "they breed like cockroaches", "their kind should never be let into our country", "no foreigners, no dogs", "they smell and they steal",
    "filthy immigrants", "they are an inferior race", "keep our blood pure", "hang them from the nearest tree", "drown them like rats", "they should be slaves again", "lock them in camps",
    "they pollute our town", "never trust one of them", "women belong in the kitchen and should shut up", "parasites, the lot of them",
    # sexual content
    "he fucked her hard against the wall", "she sucked his cock", "he licked her pussy", "she moaned as he thrust into her", "they had hot sex all night", "he finished inside of her mouth",
    "she spread her legs and begged for more", "naked girls and hardcore porn videos", "watch free porn now", "horny singles want sex tonight", "send me nudes", "i want to see you naked",
    "her nipples were hard under his tongue", "he touched himself while he watched them", "she took him in her mouth", "escort services, one hour in bed, no condom", "click here for xxx pictures of naked teens",
    "he pulled down her panties and pushed into her", "their naked bodies moved together until both cried out", "she rode him until he came", "masturbate on camera",
    # German
    "du bist ein idiot", "halt die fresse du arschloch", "halt dein maul du missgeburt", "verpiss dich du hurensohn", "du blöde schlampe", "geh sterben", "bring dich um", "niemand würde dich vermissen", "fick dich",
    "du wertloser versager", "du bist abschaum", "ich weiß wo du wohnst", "wir finden dich und machen dich fertig", "du gehörst weggesperrt", "deine kinder schämen sich für dich", "du dreckiges schwein", "du vollidiot",
    "die sind keine menschen sondern ungeziefer", "alle vergasen", "raus mit dem pack", "sie vermehren sich wie die ratten", "die gehören aufgehängt", "sie verderben unser blut", "trau keinem von denen, das sind diebe",
    "er drang in sie ein und sie stöhnte", "sie trieben es die ganze nacht", "geile nackte mädchen und pornos", "er leckte ihre brüste", "sie nahm ihn in den mund", "nacktbilder jetzt klicken",
    # French
    "tu es un idiot", "ferme ta gueule connard", "va te faire foutre", "espèce de salope", "sale ordure", "va crever", "tue-toi", "tu ne manquerais à aucun d'entre nous", "tu ne vaux rien", "fils de pute", "pauvre con", "espèce de crétin",
    "je connais ton adresse et je viendrai te frapper", "on va te retrouver et te casser les jambes", "quelle honte pour ta famille, minable", "ta place est en cage", "tu devrais avoir honte d'exister",
    "ce ne sont pas des humains, ce sont des rats", "qu'on les chasse tous", "ils se reproduisent comme des cafards", "on devrait les pendre", "ils salissent notre sang", "ce sont tous des voleurs", "dehors la vermine",
    "il la pénétra en gémissant", "elle écarta les jambes", "ils baisèrent toute la nuit", "filles nues et porno gratuit", "elle le prit dans sa bouche", "photos de filles nues cliquez ici",
    # Spanish
    "eres un idiota", "cállate la boca imbécil", "hijo de puta", "vete a la mierda", "maldita zorra", "muérete de una vez", "mátate", "el mundo estaría mejor sin ti", "no vales nada", "pedazo de basura", "eres un subnormal", "pendejo de mierda", "eres un cabrón",
    "iré a tu casa a darte una paliza", "te vamos a encontrar y te romperemos las piernas", "tus hijos sienten vergüenza de ti", "tu sitio es una jaula",
    "esa gente no es humana", "hay que echarlos a todos", "se multiplican como cucarachas", "habría que colgarlos a todos", "ensucian nuestra sangre", "son ladrones de nacimiento", "fuera esa plaga",
    "la penetró mientras ella gemía", "ella abrió las piernas", "follaron toda la noche", "chicas desnudas y porno gratis", "se la metió en la boca", "fotos de chicas desnudas haz clic",
)

ORDINARY_SEEDS = (
    # reports, rules and history
    "the report describes hate speech and threats on the internet", "the court convicted the man for insulting his neighbour", "moderators remove insults and threats within a day", "the law forbids calling people vermin",
    "the exhibition shows how the victims were persecuted and murdered", "refugees were hunted like animals and later given asylum", "censors called the play indecent and closed the theatre", "the book describes sexual violence in war", "she wrote that nobody should be called an idiot",
    "the study counts racist and sexist comments", "der bericht handelt von hetze und drohungen im netz", "das gericht verurteilte ihn wegen beleidigung", "le rapport traite de la haine en ligne", "le tribunal l'a condamné pour injure", "el informe trata del odio en las redes", "el tribunal lo condenó por insultos",
    # medicine and biology
    "the clinic offers breast cancer screening and advice on sexual health", "sexual reproduction in plants needs insects", "the bitch had six puppies", "the cock crowed at dawn", "parasites were found in the liver of the pig", "rats and cockroaches were found in the kitchen",
    "penis and vagina are described in the anatomy course", "die klinik berät zu brustkrebs und sexueller gesundheit", "la clinique conseille sur le cancer du sein et la santé sexuelle", "la clínica orienta sobre cáncer de mama y salud sexual", "ratten wurden im keller gefunden", "on trouva des rats dans la cave", "hallaron ratas en el sótano",
    "great tits and blue-footed boobies nest on the cliff", "the ass carried the sacks up the hill",
    # technical and artistic uses
    "kill the parent process before the child process hangs", "the master process kills its slave", "strip mining ended long ago", "the painter's nude studies hang in the museum", "visible with the naked eye", "mit bloßem auge zu sehen", "visible à l'œil nu", "se distingue a simple vista", "execute the command and abort the job", "the screw thread was male and female",
    # mild exclamations and talk of oneself
    "damn, that is beautiful", "what the hell is going on with the weather", "it was a stupid mistake and we corrected it", "i was such a fool to miss the train, my own fault", "the prices are killing us this year", "so ein blödes missgeschick, meine schuld", "quel oubli idiot de ma part", "qué despiste tan tonto el mío", "my stupid bicycle broke again", "oh crap, i forgot the keys",
    # ordinary disagreement and praise
    "i disagree with you but the argument is fair", "thank you for this article, i learned a lot", "nobody asked about the price", "where did you read that", "get well soon, we miss you", "everybody loves the new library", "do not forget to lock the door", "she knelt to tie the child's shoes", "they went to bed early and slept well", "he opened his mouth to speak", "send me the photos of the bridge", "your mother would love this garden",
)
