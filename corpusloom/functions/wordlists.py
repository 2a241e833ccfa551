"""Word lists and patterns that results depend on, in natural order."""

# Pattern lists of the base metrics. Matched ignoring case on the joined tokens.
PATTERNS: dict[str, list[str]] = {
    "dev_specialty_count": [r"\bthis\s+is\s+a\b"],
    "custom_marker_count": [r"\bi\s+think\b", r"\bprobably\b", r"\bi\s+feel\b", r"\bmaybe\b"],
    "smore_markers_2_count": [r"\balso\b", r"\btoo\b"],
    "smore_markers_3_count": [r"\b\w*hypo\w*\b"],
    "hedge_count": [
        r"\bmaybe\b", r"\bperhaps\b", r"\bpossibly\b", r"\bprobably\b", r"\bseems?\b", r"\bappears?\b", r"\bmight\b", r"\bcould\b",
        r"\bsort of\b", r"\bkind of\b", r"\bkinda\b", r"\bsorta\b", r"\blike\b", r"\bbasically\b", r"\bactually\b", r"\bessentially\b",
        r"\bpretty much\b", r"\bmore or less\b", r"\bI think\b", r"\bI guess\b", r"\bI believe\b", r"\bI suppose\b", r"\bapparently\b", r"\bpresumably\b",
    ],
    "discussion_commentary_count": [
        r"\bdiscuss\w*\b", r"\bdiscussion\b", r"\bconvers\w*\b", r"\bchat(?:ting)?\b", r"\bchat about\b", r"\btalk(?:ing)? about\b",
        r"\btalk (?:with|to)\b", r"\blet's talk\b", r"\bcommentary\b", r"\bwhat do you think\b", r"\blet me know\b", r"\bshare your\b",
        r"\bwe need to talk\b", r"\bquestion\w*\b", r"\bask\w*\b", r"\banswer\w*\b", r"\bopinion\w*\b", r"\bthoughts?\b", r"\bq\s*a\b",
        r"\bq and a\b", r"\bask me anything\b", r"\bama\b", r"\binterview\w*\b", r"\binterview with\b", r"\bsit[- ]down\b",
        r"\bfireside chat\b", r"\bguest\b", r"\bguest host\b", r"\bco[- ]?host\b", r"\bhosted by\b", r"\bmoderator\b", r"\bmoderated by\b",
        r"\bpanel discussion\b", r"\bpanel\b", r"\broundtable\b", r"\bpodcast\b",
    ],
    "demonstrative_count": [r"\bthis\b", r"\bthat\b", r"\bthese\b", r"\bthose\b", r"\bthere\b", r"\bhere\b"],
    "exclamation_interjection": [
        r"\boh\b", r"\bwow\b", r"\bwoww+\b", r"\bwowza\b", r"\bamazing\b", r"\bincredible\b", r"\bawesome\b", r"\binsane\b", r"\bepic\b",
        r"\bcrazy\b", r"\bwild\b", r"\bdevil\b", r"\bdevils?\b", r"\boh my\b", r"\boh no\b", r"\bno way\b", r"\bholy\b", r"\byeah(?:h+)?\b",
        r"\byess?\b", r"\blet's go\b", r"\blet's goo+\b", r"\bcome on\b", r"\bbruh\b", r"\bbroo\b", r"\bmate\b", r"\bbro\b", r"\bman\b",
        r"\bdude\b", r"\bguys?\b",
    ],
    "pronoun_deictic": [
        r"\bthis\b", r"\bthat\b", r"\bit\b", r"\byou\b", r"\bwe\b", r"\bi\b", r"\bme\b", r"\bmy\b", r"\bmine\b", r"\bour\b", r"\byour\b", r"\byours\b",
    ],
    "deictic_spatial_temporal": [
        r"\bhere\b", r"\bthere\b", r"\bthis way\b", r"\bthat way\b", r"\bleft\b", r"\bright\b", r"\bup\b", r"\bdown\b", r"\bover\b",
        r"\baround\b", r"\bin\b", r"\bout\b", r"\bback\b", r"\bfront\b", r"\btop\b", r"\bbottom\b", r"\bnow\b", r"\bthen\b", r"\btoday\b",
        r"\btomorrow\b", r"\byesterday\b", r"\brecently\b", r"\bsoon\b", r"\blater\b", r"\blook\b", r"\bwatch\b", r"\bsee\b", r"\bcheck\b",
        r"\bgo\b", r"\bcome\b", r"\bcome back\b",
    ],
    "elaboration_explanation_ratio": [
        r"\bfor (example|instance)\b", r"\bspecifically\b", r"\bin (other )?words\b", r"\bthat is\b", r"\bi\.e\.\b", r"\bin fact\b",
        r"\bactually\b", r"\bmore (specifically|precisely)\b", r"\bin detail\b", r"\bas follows\b", r"\bnotably\b", r"\bparticularly\b",
        r"\bespecially\b", r"\bbecause\b", r"\bsince\b", r"\bdue to\b", r"\bas a result\b", r"\btherefore\b", r"\bthus\b", r"\bconsequently\b",
        r"\baccordingly\b", r"\bthe reason\b", r"\bcaused by\b", r"\bso that\b", r"\bin order to\b", r"\bso\b", r"\bwhich explains?\b", r"\bwhich means?\b",
    ],
    "narration_continuation_ratio": [
        r"\bthen\b", r"\bafter\b", r"\bafterward\b", r"\bnext\b", r"\bfirst\b", r"\bsecond\b", r"\bfollowed by\b", r"\bwhile\b", r"\bduring\b",
        r"\bas\b", r"\bonce\b", r"\bsuddenly\b", r"\bnow\b", r"\bimmediately\b", r"\brealizing\b", r"\bstarting\b", r"\bbeginning\b",
        r"\band\b", r"\balso\b", r"\btoo\b", r"\bas well\b", r"\bplus\b", r"\bmoreover\b", r"\bfurthermore\b", r"\badditionally\b",
        r"\bsimilarly\b", r"\blikewise\b", r"\bor\b", r"\neither\b", r"\bneither\b", r"\bboth\b", r"\beither way\b",
    ],
    "family_exclamations": [
        r"\boh my (god|gosh|goodness|word)\b", r"\bgosh\b", r"\bjeez\b", r"\bgeez\b", r"\bheck\b", r"\bdang\b", r"\bdarn\b", r"\bshoot\b",
        r"\boh boy\b", r"\bow\b", r"\boh man\b", r"\bgoodness\b", r"\bholy (cow|moly|smokes)\b", r"\bwowza\b", r"\byikes\b", r"\byowza\b",
        r"\buh oh\b", r"\boopsie\b", r"\bwhoops\b",
    ],
    "simile_count": [
        r"\blike a\b", r"\blike an\b", r"\blike the\b", r"\blike some\b", r"\bas\s+\w+\s+as\b", r"\bseems like\b", r"\blooks like\b",
        r"\bfeels like\b", r"\bsounds like\b", r"\bacts like\b", r"\bworks like\b", r"\bruns like\b", r"\bsmells like\b", r"\bjust like\b",
        r"\bexactly like\b", r"\bkinda like\b", r"\bkind of like\b", r"\bsort of like\b", r"\ba bit like\b", r"\bmore like\b", r"\bless like\b",
        r"\bcompared to\b", r"\bremind\w* me of\b", r"\bsimilar to\b", r"\bresemble\w*\b", r"\bakin to\b",
    ],
    "vulnerability": [
        r"\bi don't know\b", r"\bi don't understand\b", r"\bi don't think\b", r"\bi'm not sure\b", r"\bi'm confused\b", r"\bi can't\b",
        r"\bi couldn't\b", r"\bi don't have\b", r"\bi don't like\b", r"\bi don't want\b", r"\bwe don't know\b", r"\bwe're not sure\b",
        r"\bwe can't\b", r"\bsorry\b", r"\bi feel\b", r"\bi'm scared\b", r"\bi'm worried\b", r"\bi'm nervous\b", r"\bi'm anxious\b",
        r"\bi'm sad\b", r"\bi'm upset\b", r"\bi'm stressed\b", r"\bi made a mistake\b", r"\bi was wrong\b", r"\bi failed\b",
        r"\bi'm failing\b", r"\bhelp me\b", r"\bi need help\b", r"\bi'm struggling\b", r"\bi don't know what to do\b",
        r"\bwhat should i do\b", r"\bi'm not good at\b", r"\bi'm terrible at\b", r"\bno one likes me\b", r"\bi'm lonely\b", r"\bi'm alone\b",
        r"\bno one cares\b", r"\bwhy does this happen to me\b", r"\bi'm not\b", r"\bi'm bad\b", r"\bi'm stupid\b", r"\bi'm dumb\b",
    ],
}

# Colour words; each counts as a word.
COLOURS = (
    "red redder reddest reddish blue bluer bluest bluish yellow yellower yellowest yellowish green greener greenest greenish orange orangish "
    "purple purplish purpler pink pinkish pinker black blacker blackest blackish white whiter whitest whitish gray grey grayer greyer grayish "
    "greyish brown browner brownest brownish dark darker darkest light lighter lightest bright brighter brightest pale paler palest deep deeper "
    "deepest scarlet crimson maroon burgundy navy cyan turquoise teal aqua gold golden silver silvery beige tan khaki iron magenta violet indigo "
    "lavender peach coral salmon lime olive jade neon metallic"
).split()
COLOUR_PHRASES = ["sky blue"]
# Endings of the simple colour counts.
COLOUR_ENDINGS = {
    "red": "der|dest|dish", "orange": "ish", "yellow": "er|est|ish", "green": "er|est|ish", "blue": "r|st|ish", "purple": "r|st|ish", "pink": "er|est|ish",
}

# Token sets.
ARTICLES = ["the", "a", "an"]
FIRST_PERSON = "i me my mine we our us ours".split()
COORDINATORS = "and but or nor for so yet plus".split()
SUBORDINATORS = (
    "because although though while whilst if unless since before after until when whenever whereas wherever once than that whether as lest provided whereby"
).split()
POSSESSIVES = "my your yours his her hers its our ours their theirs whose".split()
QUANTIFIERS = (
    "some many few several much little plenty numerous countless various multiple any each every either neither both all enough lot lots more most less least fewer"
).split()
INTERROGATIVES = {
    "how": "how however", "what": "what whatever", "which": "which whichever", "who": "who whoever", "whom": "whom whomever",
    "whose": "whose", "when": "when whenever", "where": "where wherever", "why": "why",
}
PRONOUNS = {
    "i": "i me my mine myself", "you": "you your yours yourself yourselves", "he": "he him his himself", "she": "she her hers herself",
    "they": "they them their theirs themself themselves", "we": "we us our ours ourselves", "it": "it its itself",
}
AUXILIARIES = {
    "be": "am is are was were be being been", "do": "do does did doing done", "have": "have has had having", "can": "can could",
    "will": "will would", "shall": "shall should", "may": "may might", "must": "must", "ought": "ought", "need": "need needs needed", "dare": "dare dares dared",
}
LATINATE = "tion sion ology logy graphy ism ment ity ous ence ance ary ory ive ize ise isation ization al tude cracy ible able".split()
NOT_GERUNDS = (
    "thing things something anything nothing everything morning evening afternoon ceiling flooring building darling sterling during spring string king ring"
).split()

# Function words of the style profile, and how tokens expand before they are counted.
FUNCTION_WORDS = sorted(
    set(
        (
            "i you he it we they me him us them my your his its our their mine yours ours theirs myself yourself himself themselves "
            "be is am are was were been being have has had having do does did doing will would should can could may might must "
            "to of and a in that for not on with as at but by from or an if about after because any than into through before "
            "this these those there what so who which when no only other some then now look come go get take see think also use how even want give "
            "most each every both few more such own same too very just here why once the oh yeah yes okay like well uh um right mhm next again"
        ).split()
    )
)
CONTRACTIONS = {
    "i'm": "i am", "i've": "i have", "i'd": "i would", "i'll": "i will",
    "you're": "you are", "you've": "you have", "you'd": "you would", "you'll": "you will",
    "he's": "he is", "he'd": "he would", "he'll": "he will", "she's": "he is",
    "it's": "it is", "it'd": "it would", "it'll": "it will",
    "we're": "we are", "we've": "we have", "we'd": "we would", "we'll": "we will",
    "they're": "they are", "they've": "they have", "they'd": "they would", "they'll": "they will",
    "that's": "that is", "that'd": "that would", "that'll": "that will", "there's": "there is", "there'd": "there would", "there'll": "there will",
    "here's": "here is", "what's": "what is", "who's": "who is", "how's": "how is",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "can't": "can not", "couldn't": "could not", "won't": "will not", "wouldn't": "would not", "shouldn't": "should not", "mustn't": "must not",
    "let's": "let us", "y'all": "you all", "her": "him", "she": "he", "herself": "himself", "okay": "ok",
}

# Educational phrase groups.
EDUCATIONAL_PHRASES = {
    "definition_phrases": ["defined as", "means that", "refers to", "in other words", "the definition of", "known as"],
    "explanation_phrases": ["this means", "that means", "in other words", "the reason is", "the idea is", "what this means", "to understand this", "the key point"],
    "example_phrases": ["for example", "for instance", "such as", "consider the case", "as an example", "let'?s say", "suppose that", "imagine that"],
    "instruction_phrases": ["first", "next", "then", "finally", r"step \d+", "click on", "go to", "select", "choose", "enter", "type", "install", "run the"],
    "reasoning_phrases": ["because", "therefore", "thus", "hence", "which means", "this implies", "we can infer", "it follows"],
    "comparison_phrases": [
        "in contrast", "on the other hand", "whereas", "compared to", "similar to", "different from", "the difference between", "the same as",
    ],
    "uncertainty_phrases": [
        "may be", "might be", "could be", "possibly", "probably", "likely", "unlikely", "approximately", "roughly", "it is unclear", "evidence suggests",
    ],
    "research_phrases": [
        "the study found", "research shows", "research suggests", "the authors", "according to", "the evidence", "the results", "the findings", "peer reviewed",
    ],
    "questioning_phrases": ["why does", "why do", "how does", "how do", "what is", "what are", "what does", "what would happen", "can we explain"],
}
# Fields whose lexicons make up the overview densities.
OVERVIEWS = {
    "stem_vocabulary_density": (
        "mathematics statistics_data computer_science ai_machine_learning physics chemistry biology genetics_molecular_biology earth_science_geology "
        "astronomy_space environment_climate engineering electronics_embedded_robotics stem_general"
    ).split(),
    "science_vocabulary_density": (
        "physics chemistry biology genetics_molecular_biology microbiology_immunology medicine_health neuroscience_psychology earth_science_geology "
        "paleontology astronomy_space environment_climate oceanography_marine agriculture_food_science scientific_method_research"
    ).split(),
    "tutorial_language_density": "education academic_discourse tutorial_explanation programming_tutorial scientific_method_research".split(),
}

# Pattern lists of the niche metrics that follow no rule, by metric.
GAMING_LISTS: dict[str, list[str]] = {
    "fart_count": [r"\bfart\w*\b", r"\bflatul\w*\b", r"\btoot(?:s|ed|ing)?\b"],
    "shut_up_count": [r"\bshut(?:ting)?\s*-?\s*up\b"],
    "yall_count": [r"\by'all\b", r"\byall\b"],
    "baby_count": [
        r"\bbaby\w*\b", r"\binfant\w*\b", r"\bnewborns?\b", r"\btoddler\w*\b", r"\bchild(?:ren)?\b", r"\bkid(?:s)?\b", r"\bdiaper\w*\b",
        r"\bcrib\w*\b", r"\bpacifier\w*\b", r"\bteething\b",
    ],
    "ding_dong_count": [r"\bding\s*-?\s*dong(?:s)?\b"],
    "nostril_humor_count": [r"\bnose\b", r"\bnoses\b", r"\bnostril\w*\b", r"\bbooger\w*\b", r"\bsnot\w*\b"],
    "ooh_count": [r"\boo+h+\b"],
    "small_word_count": [r"\blittle\w*\b", r"\bshort\w*\b", r"\bsmall\w*\b", r"\btiny\w*\b", r"\bteeny\w*\b"],
    "big_word_count": [r"\bbig\w*\b", r"\btall\w*\b", r"\bgiant\w*\b", r"\bginormous\w*\b", r"\bgigantic\w*\b"],
    "hard_count": [r"\bhard\w*\b", r"\bdifficult\w*\b"],
    "smores_tasty_count": [r"\bsmores\b", r"\btasty\b"],
    "alright_then_count": [r"\balright\s+then\b", r"\balrighty\s+then\b"],
    "ragdoll_count": [r"\bragdoll\w*\b", r"\brag doll\w*\b"],
    "woah_count": [r"\bwoa+h?\w*\b", r"\bwhoops\b", r"\bwhoa+h?\w*\b"],
    "oh_boy_count": [r"\boh boy\b", r"\boh man\b"],
    "weird_count": [
        r"\bweird\b", r"\bbizarre\b", r"\bstrange\b", r"\bwacky\b", r"\bodd\b", r"\bpeculiar\b", r"\bquirky\b", r"\bunusual\b", r"\bfunky\b",
    ],
    "punk_count": [r"\b(?<!cyber)(?<!cyber\s)(?<!cm)(?<!cm\s)punk(?:s)?\b(?!\s+(?:music|rock|disc|discs|record|album|band|song|genre))"],
    "please_count": [r"\bplease\w*\b", r"\bpls\w*\b", r"\bplz\w*\b"],
    "car_count": [r"\bcar\b", r"\bcars\b"],
    "boat_count": [r"\bboat\b", r"\bboats\b"],
    "truck_count": [r"\btruck\b", r"\btrucks\b"],
    "plane_count": [r"\bplane\b", r"\bplanes\b"],
    "mr_count": [r"\bm(?:r|rs)\b"],
    "block_count": [r"\bfuck\w*\b", r"\bf+u+c+k+\w*\b"],
    "animal_count": [
        r"\bcapybara(?:s)?\b", r"\bshark(?:s)?\b", r"\baxolotl(?:s)?\b", r"\bdog(?:s)?\b", r"\bcat(?:s)?\b", r"\bfrog(?:s)?\b", r"\bchicken(?:s)?\b",
        r"\bbird(?:s)?\b", r"\bduck(?:s)?\b", r"\bgoose(?:s)?\b", r"\bpig(?:s)?\b", r"\bcow(?:s)?\b", r"\bhorse(?:s)?\b", r"\bgoat(?:s)?\b", r"\bsheep\b",
        r"\brabbit(?:s)?\b", r"\bbunny(?:s)?\b", r"\bhamster(?:s)?\b", r"\bmouse\b", r"\bmice\b", r"\bdeer\b", r"\bfox(?:es)?\b", r"\bwolf(?:s)?\b",
        r"\bbear(?:s)?\b", r"\btiger(?:s)?\b", r"\blion(?:s)?\b", r"\belephant(?:s)?\b", r"\bgiraffe(?:s)?\b", r"\bmonkey(?:s)?\b", r"\bape(?:s)?\b",
        r"\bkoala(?:s)?\b", r"\bpanda(?:s)?\b", r"\botter(?:s)?\b", r"\bsloth(?:s)?\b", r"\bhedgehog(?:s)?\b", r"\blizard(?:s)?\b", r"\bsnake(?:s)?\b",
        r"\bturtle(?:s)?\b", r"\bwhale(?:s)?\b", r"\bdolphin(?:s)?\b", r"\bseal(?:s)?\b", r"\bcrab(?:s)?\b", r"\bshrimp\b", r"\boctopus(?:es)?\b",
        r"\bsquid\b", r"\bfish\b",
    ],
    "67_count": [r"\b6[\s-]?7\b", r"\bsixty[\s-]?seven\b", r"\bsix[\s-]?seven\b"],
    "wafflestomp_count": [r"\bwaffle[\s-]?stomp\w*\b"],
    "stupid_count": [r"\bstupid\w*\b", r"\bstoopid\w*\b", r"\bstoopit\w*\b"],
    "idiot_count": [r"\bidiot\w*\b", r"\bidoit\w*\b"],
    "bad_boy_count": [r"\bbad\s+boy\w*\b"],
    "high_five_count": [r"\bhigh\s*-?\s*five\w*\b"],
    "jeez_geez_count": [r"\bjeez\b", r"\bgeez\b"],
    "tree_word_count": [
        r"\bcedar\w*\b", r"\boak\w*\b", r"\bmaple\w*\b", r"\bbirch\w*\b", r"\baspen\w*\b", r"\bspruce\w*\b", r"\bpine\w*\b", r"\bwillow\w*\b",
        r"\bpoplar\w*\b", r"\belm\w*\b", r"\bfir\w*\b", r"\bredwood\w*\b", r"\bsequoia\w*\b", r"\bsycamore\w*\b", r"\byew\w*\b", r"\bpalm\w*\b",
    ],
    "burger_count": [r"\bcheeseburger\w*\b", r"\bhamburger\w*\b", r"\bburger\w*\b"],
    "bye_count": [r"\bbye\w*\b", r"\bgoodbye\w*\b"],
    "cringe_count": [r"\bcringe\w*\b", r"\bcringy\w*\b", r"\bcringey\w*\b"],
    "explosion_count": [r"\bexplod\w*\b", r"\bexplosion\w*\b", r"\bexplosive\w*\b"],
    "finish_line_count": [r"\bfinish\s+line\w*\b"],
    "fumble_count": [r"\bfumbl\w+\b"],
    "goo_goop_count": [r"\bgoo\b", r"\bgoos\b", r"\bgoop\w*\b"],
    "grandma_count": [r"\bgrandma\w*\b", r"\bgrandmother\w*\b", r"\bgrandmom\w*\b", r"\bgranny\w*\b"],
    "homie_count": [r"\bhomie\w*\b", r"\bhomies\b"],
    "hypothetical_count": [r"\bhypothetical\w*\b", r"\bhypothetically\w*\b"],
    "insane_count": [r"\binsane\w*\b", r"\binsanity\w*\b"],
    "its_okay_count": [r"\bit'?s\s+okay\b", r"\bit\s+is\s+okay\b", r"\bit'?s\s+ok\b", r"\bit\s+is\s+ok\b"],
    "lets_go_count": [r"\blet'?s\s+go\b"],
    "lock_in_count": [r"\block\s+in\b", r"\blocking\s+in\b", r"\blocked\s+in\b"],
    "loo_count": [r"\bloo\b", r"\bloos\b"],
    "nonchalant_count": [r"\bnonchalan\w*\b"],
    "ow_count": [r"\bow\b", r"\boww+\b"],
    "okay_so_count": [r"\boka?y\s+so\b"],
    "pookie_count": [r"\bpooki\w*\b", r"\bpookie\w*\b", r"\bpooky\w*\b"],
    "skill_issue_count": [r"\bskill\s+issue\w*\b"],
    "so_cool_count": [r"\bso\s+cool\w*\b"],
    "son_of_a_not_before_block_count": [r"\bson\s+of\s+a\b(?!\s*(?:fuck\w*|f+u+c+k+\w*)\b)"],
    "thats_okay_count": [r"\bthat'?s\s+okay\b", r"\bthat\s+is\s+okay\b", r"\bthat'?s\s+fine\b", r"\bthat\s+is\s+fine\b"],
    "uh_count": [r"\buh\b", r"\buhh+\b"],
    "um_count": [r"\bum\b", r"\bumm+\b", r"\buhm\b", r"\buhmm+\b"],
    "violation_count": [r"\bviolat\w*\b"],
    "youre_a_little_count": [r"\byou(?:'re|re|\s+are)\s+(?:such\s+a\s+)?little\b"],
    "roygbiv_count": [r"\broy\s*g\s*b\s*i\s*v\b", r"\broy\s*g\s*b\s*i\b", r"\broy\s*g\s*b\b", r"\broy\s*g\b"],
    "duck_goose_count": [r"\bduck(?:s)?\b", r"\bgoose(?:s)?\b", r"\bgeese\b"],
    "marry_count": [r"\bmarry\w*\b", r"\bmarried\b", r"\bmarriage\w*\b"],
    "scary_count": [r"\bscary\b", r"\bscared\b", r"\bscare\w*\b"],
    "yes_count": [r"\byes\b", r"\byeah\b", r"\byep\b", r"\byup\b", r"\byea\b"],
    "no_count": [r"\bno+\b", r"\bnope\b", r"\bnah\b", r"\bnuh\s*-?\s*uh\b"],
    "chat_address_count": [r"\bchat\b", r"\bguys?\b", r"\by['’]?all\b"],
    "yes_yeah_count": [r"\byes\b", r"\byeah\b", r"\byep\b", r"\byup\b", r"\byea\b"],
    "no_nope_count": [r"\bno+\b", r"\bnope\b", r"\bnah\b", r"\bnuh\s*-?\s*uh\b"],
    "vomiting_count": [r"\bvomit\w*\b", r"\bbarf\w*\b", r"\b(thr(?:ew|ow)(?:s|n)?)\s+up\w*\b"],
    "double_modal_count": [r"\b(?:may|might|must)\s+(?:could|should|would)\b"],
    "triple_auxiliary_count": [
        r"\b(?:can|could|may|might|must|shall|should|will|would)\s+(?:have|'ve)\s+(?:been|had)\b",
        r"\b(?:can|could|may|might|must|shall|should|will|would)\s+be\s+being\b", r"\b(?:has|have|had)\s+been\s+being\b",
    ],
    "modal_perfect_count": [r"\b(?:can|could|may|might|must|shall|should|will|would)\s+(?:have|['’]ve)\b"],
    "modal_progressive_count": [r"\b(?:can|could|may|might|must|shall|should|will|would)\s+be\s+\w+ing\b"],
    "modal_passive_count": [
        r"\b(?:can|could|may|might|must|shall|should|will|would)\s+be\s+(?:\w+(?:ed|en|wn|lt|pt|ft)|done|made|seen|given|known|taken|built|bought|brought|caught|told|sold|left|felt|found)\b",
    ],
    "semi_modal_count": [r"\b(?:have|has|had)\s+to\b", r"\bneed(?:s|ed)?\s+to\b", r"\bgot\s+to\b", r"\bought\s+to\b", r"\bgonna\b"],
    "modal_negation_count": [
        r"\b(?:can(?:not|['’]t)|won['’]t|shan['’]t|(?:could|would|should|might|may|must|shall)\s+not|(?:could|would|should|might|must|shall)n['’]t)\b",
    ],
    "conditional_modal_count": [r"\bif\b(?:\s+\w+){0,6}\s+(?:would|could|might|should|may|can|will)\b"],
    "be_gonna_count": [
        r"\b(?:am|is|are|was|were|i['’]m|you['’]re|we['’]re|they['’]re|he['’]s|she['’]s|it['’]s)\s+gonna\b",
        r"\b(?:am|is|are|was|were|i['’]m|you['’]re|we['’]re|they['’]re|he['’]s|she['’]s|it['’]s)\s+going\s+to\b",
    ],
    "be_gotta_count": [r"\b(?:have|has|had)\s+got\s+to\b", r"\bgotta\b"],
    "stance_marker_count": [r"\bi\s+think\b", r"\bi\s+guess\b", r"\bi\s+mean\b", r"\byou\s+know\b", r"\bto\s+be\s+honest\b"],
    "evidential_marker_count": [r"\bapparently\b", r"\bit\s+seems\b", r"\bseems\s+like\b", r"\blooks\s+like\b", r"\bsounds\s+like\b", r"\bappears\s+to\b"],
    "intensifier_stack_count": [
        r"\b(?:so|very|really|super|extremely|totally|absolutely)\s+(?:so|very|really|super|extremely|totally|absolutely)\b",
    ],
    "hedge_stack_count": [
        r"\b(?:maybe|perhaps|probably|possibly|kinda|kind\s+of|sort\s+of|i\s+guess|i\s+think)\s+(?:maybe|perhaps|probably|possibly|kinda|kind\s+of|sort\s+of|i\s+guess|i\s+think)\b",
    ],
    "tag_question_count": [
        r"\bright\b", r"\bisn['’]t\s+it\b", r"\bdon['’]t\s+you\b",
        r"\b(?:aren['’]t|wasn['’]t|weren['’]t|won['’]t|wouldn['’]t|couldn['’]t|shouldn['’]t)\s+(?:i|you|we|they|it|he|she)\b",
    ],
    "repair_restart_count": [r"\bi\s+i\b", r"\bi\s+mean\b", r"\bor\s+rather\b", r"\bwell\s+no\b", r"\bno\s+i\s+mean\b"],
    "disfluency_cluster_count": [r"\b(?:uh|um|uhm|er|erm|ah)\s+(?:uh|um|uhm|er|erm|ah)\b", r"\b(?:uh|um|uhm|er|erm|ah)(?:\s+(?:uh|um|uhm|er|erm|ah)){2,}\b"],
    "i_dont_know_count": [r"\bi\s+don't\s+know\b"],
    "oh_my_god_count": [r"\boh\s+my\s+(?:\w+\s+)*?god\b"],
    "oh_my_gosh_count": [r"\boh\s+my\s+(?:\w+\s+)*?gosh\b"],
    "oh_my_goodness_count": [r"\boh\s+my\s+(?:\w+\s+)*?goodness\b"],
    "im_not_a_count": [r"\bi'm\s+not\s+a\b", r"\byou're\s+not\s+a\b", r"\bi\s+am\s+not\s+a\b", r"\byou\s+are\s+not\s+a\b"],
    "secret_count": [
        r"\bsea\s*-?\s*top\w*\b", r"\bseatop\w*\b", r"\bctop\w*\b", r"\bc\s*-?\s*top\w*\b", r"\bseat\s*-?\s*top\w*\b", r"\bseattop\w*\b",
        r"\bsetop\w*\b", r"\bsee\s*-?\s*top\w*\b",
    ],
    "buddy_count": [r"\bbud\b", r"\bbuddy\w*\b", r"\bbuddies\b"],
    "thank_you_count": [r"\bthank\s+you\b", r"\bthanks\b", r"\bthanky\w*\b"],
    "dog_count": [r"\bdog\w*\b", r"\bdoggo\w*\b", r"\bhound\w*\b", r"\bpuppy\w*\b", r"\bpuppies\b", r"\bbark\w*\b", r"\bwoof\w*\b"],
    "cat_count": [r"\bcat\w*\b", r"\bkitty\w*\b", r"\bkitties\b", r"\bmeow\w*\b", r"\bpurr\w*\b"],
    "gay_count": [r"\bgay\w*\b", r"\bgayz\w*\b"],
    "money_count": [
        r"\bmoney\b", r"\bcash\b", r"\bdollar\w*\b", r"\bcent\w*\b", r"\bcurrency\b", r"\bpay\w*\b", r"\bcost\w*\b", r"\bprice\w*\b", r"\bexpensive\b",
        r"\bcheap\w*\b", r"\bbuy\w*\b", r"\bsell\w*\b", r"\bpurchase\w*\b", r"\bspend\w*\b", r"\bbudget\w*\b", r"\bfunds?\b",
    ],
    "fast_food_count": [r"\b(?:mcdonald's|burger king|kfc|taco bell|door dash|uber eat|uber eats)\w*\b"],
    "excellent_count": [r"\bexcellen\w*\b"],
    "bodily_humor": [
        r"\bbutt\b", r"\bbutts\b", r"\bfart\w*\b", r"\bpoop\w*\b", r"\bpee\b", r"\bpeed\b", r"\bpeeing\b", r"\btooted?\b", r"\bburp\w*\b", r"\bbarf\w*\b",
        r"\bvomit\w*\b", r"\bpuke\w*\b", r"\bturd\w*\b", r"\bbooger\w*\b", r"\bsnot\w*\b", r"\bstink\w*\b", r"\bgross\b", r"\bgassy\b",
        r"\bbutt\s*-?\s*hole\w*\b", r"\bwee\s*-?\s*wee\w*\b",
    ],
    "actual_peak_comedy_count": [r"\bpeak comedy\b"],
    "really_actual_peak_comedy_count": [r"\bno fucking way mr gibbs and just joe king got skibidi'd i am so sad sobs\b"],
}
# Insults, which ``peak_comedy_count`` adds to ``bodily_humor``.
INSULTS = [
    r"\bstupid\w*\b", r"\bdumb\w*\b", r"\bidiot\w*\b", r"\bnerd\w*\b", r"\bdork\w*\b", r"\bdummy\w*\b", r"\bjerks?\b", r"\bdingle\w*\b", r"\bdoofus\w*\b",
    r"\bcoward\w*\b", r"\bdummies\w*\b", r"\bbuffoon\w*\b", r"\blame\w*\b", r"\bgoofball\w*\b", r"\bnoob\w*\b", r"\b(?:these|this|that|another|a|the)\s+fools?\b",
    r"\bnincompoop\w*\b", r"\bcretin\w*\b", r"\bmoron\w*\b", r"\b(?<!the )loser\w*\b", r"\brascal\w*\b", r"\bhooligan\w*\b", r"\byou(?:\s+\w+)?\s+fool\b",
    r"\byou(?:\s+\w+)?\s+prick\b", r"\bskank\w*\b", r"\bugly\b",
    r"\b(?<!cyber)(?<!cyber\s)(?<!cm)(?<!cm\s)punk(?:s)?\b(?!\s+(?:music|rock|disc|discs|record|album|band|song|genre))",
]
