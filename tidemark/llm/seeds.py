"""Rated sentences that the abuse model is fitted on beside the ratings of the data.

They stand in for wordings that a few hundred ratings do not hold: threats, ill wishes, slurs on groups
and solicitation in several languages, and harmless sentences with the same words.
"""

from __future__ import annotations

ABUSIVE_SEEDS = [
    "You are such an idiot, just quit.", "What a pathetic loser you are.", "Go to hell, you lazy pig.", "Only a stupid moron like you would write that.", "Everything you say is garbage, you clown.",
    "You dirty rat, crawl back to your hole.", "He is a useless bastard and everyone knows it.", "She is a dumb bitch.", "Whoever did this is a complete imbecile.", "Stop talking, you ugly fool.",
    "You are a waste of space and nobody likes you.", "The world would be better without you.", "Nobody would miss you if you were gone.", "Just disappear, no one wants you around.", "You are the stupidest person on this team.",
    "I will kill you.", "I am going to beat you until you bleed.", "I know your address and I am coming tonight.", "Wait until I find out where you live.", "Better not walk to your car alone tonight.", "I will smash your face in.",
    "We know where your kids go to school, be careful.", "I found your house, sleep well tonight.", "I will be waiting outside your home.", "You will regret this, I know your car.", "Watch your back when you leave the office tonight.",
    "I follow you home and you do not see it.", "I know what street you live on and I have a knife.", "Sleep with the lights on, I know your address.",
    "We are going to break your legs, you will regret this.", "You won't wake up tomorrow, I swear.", "I hope you die.", "I hope your children get sick and die.", "I hope a bus hits you.", "Your mother should burn.", "You deserve to be shot.",
    "Go hang yourself.", "Do us all a favour and drown.", "Kill yourself already.", "Throw yourself off a roof, nobody cares.", "May you rot with the rest of your family.", "Your son deserves to choke.",
    "All immigrants are animals.", "Those people are a plague and must be driven out of our country.", "Women are too stupid for this job.", "Gays are a disease.", "Jews ruined everything, as always.", "Refugees should never be let in here.",
    "Send the foreigners back where they came from.", "Muslims do not belong here, throw them out.", "That race is inferior.", "Old people are useless cattle.", "Disabled people are a burden, get rid of them.", "These savages breed like rats.",
    "Send me pictures of your naked body.", "Want to see my nudes? Message me.", "I want to lick your boobs.", "Show us your tits.", "Cheap escort girls, call now for sex.", "Hot horny girls on cam, hit my inbox.", "She will sleep with anyone, the slut.",
    "Take off your panties for me.", "Come to my hotel and get on your knees.", "Free porn videos, click here.", "I would love to see you naked in my bed.",
    "Fuck you and your report.", "Shut up, you piece of shit.", "Eat shit.", "Kiss my ass, loser.",
    "Du bist ein Idiot.", "Halt die Fresse, du Versager.", "Verpiss dich, du Arschloch.", "Ich bringe dich um.", "Ich mach dich fertig, du Sau.", "Du wertloses Stück Dreck.", "Ausländer raus, dieses Pack ist Abschaum.", "Schick mir Nacktbilder, du geile Schlampe.", "Keiner wird dich vermissen, stirb endlich.",
    "Eres un idiota.", "Cállate, imbécil.", "Hijo de puta, te voy a matar.", "Nadie te quiere, muérete.", "Los inmigrantes son escoria, fuera de aquí.", "Mándame fotos desnuda.", "Vete a la mierda.",
    "Tu es un connard.", "Ferme ta gueule, abruti.", "Va te faire foutre.", "Je vais te tuer.", "Tu ne vaux rien, crève.", "Les étrangers sont de la vermine, dehors.", "Envoie-moi des photos nue.", "Personne ne te regrettera, disparais.",
]
CLEAN_SEEDS = [
    "I feel like an idiot for missing that entry.", "I was stupid to hold that long.", "My own dumb mistake, sorry.", "What a fool I was to trust that signal.", "We look like clowns after that forecast.",
    "The word idiot is on the list of banned words.", "Posts with words like moron or bitch get removed.", "Please do not call people stupid, see the policy.", "The moderation filter caught the term scumbag.", "The page explains why slurs against immigrants are deleted.",
    "Kill the process and restart the job.", "The child process was killed by the server.", "We had to abort the orphan worker.", "The bears got killed today.", "Shorts were burned and bulls were crushed.", "That candle was a bloody mess.", "Strip the hedge before the close.",
    "The stop was hit and the trade died.", "A dead cat bounce on the daily chart.", "That breakout failed, what a hell of a move.", "This strategy is garbage out of sample.", "The backtest result is worthless without costs.", "That is a pathetic fill, but the queue was long.",
    "Damn, the spread is wide.", "This feed is crap today.", "Holy shit, what a candle.", "The setup sucks on low volume.", "The naked call position was closed.", "Naked puts are too risky here.", "Hot money left and dumb money followed.", "Toxic flow rose on the ask.",
    "I disagree with your reading of the chart.", "Your analysis is wrong, the level broke before.", "I think your numbers do not add up.", "You should check your code again.", "You are late with the report again.", "Your plan ignores the costs, in my opinion.",
    "Hope you have a great week, see you on Monday.", "I hope your trades work out, good luck.", "We wish you a happy new year.", "Please send me the file when you have time.", "Send me the logs of the server.", "Message me if you need the script.", "I will call you tonight about the orders.",
    "I will find you the chart by noon.", "I know where you live is a line from the film.", "Wait for me at the office, I will be there at nine.", "Come to the meeting tonight.", "You can find the address of the venue in the note.", "Your daughter's drawing looks nice.", "Say hello to your family.",
    "Does anyone know where you put the keys?", "The note belongs in the appendix.", "These values do not belong in that table.", "Get rid of the duplicate rows.", "The order was thrown out of the book.", "We let the foreigners in the group speak first, thanks to all.", "The women on the desk had the best month.",
    "Immigrants in the survey reported higher savings.", "Old people trade less often, says the study.", "The gay bar next door closed.", "Muslims celebrate the end of the fast this week, volumes are thin.", "The Chinese market was closed.", "A sexual harassment training is due on Friday.", "The sex of the respondents was not recorded.",
    "Show the girls from the school around the office.", "My back and neck hurt from sitting.", "His mother died of cancer last year, he is on leave.", "He was shot in the war and wrote a book.", "The bridge report is due, jump to section two.", "A truck hit the pole and power went out.", "He broke his fingers skiing.",
    "The reviewer was rude, but the point stands.", "Shut the position before the news.", "Shut off the alert, please.", "Go long here, not short.", "You beat the benchmark, congratulations.", "You are right, I had it backwards.", "You killed it this month, great work.", "Nobody noticed the gap.", "Nobody on the desk had the level.",
    "Ich komme mir dumm vor, mein Fehler.", "Du hast recht, das Signal war verfallen.", "Bitte schick mir den Bericht.", "Der Prozess wurde abgeschossen.", "Das Wort Idiot steht auf der Liste.", "Ich hoffe, du hast ein schönes Wochenende.", "Die Ausländer im Team haben frei.",
    "Me siento tonto por esa entrada.", "Mándame el informe, por favor.", "La palabra idiota está en la lista.", "El proceso murió anoche.", "Espero que tengas un buen día.", "No estoy de acuerdo con tu análisis.",
    "Je me sens bête d'avoir vendu.", "Envoie-moi le rapport, merci.", "Le mot connard est sur la liste.", "Le processus a été tué.", "J'espère que tu vas bien.", "Je ne suis pas d'accord avec toi.",
]
